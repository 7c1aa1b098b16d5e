"""Structured Streaming forms of the event operators.

Each result is emitted once the watermark has passed all it depends on, so it is the batch form's result however the
events are spread over triggers, as long as none comes later than ``late`` behind the newest one. What the watermark has not passed yet stays in the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.session import materialize, scratch

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New event files below ``path`` as a stream with a declared schema and a plain timestamp for watermarks."""
    s = spark.readStream.schema(SCHEMA).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("job_id", F.get_json_object("props", "$.k").cast("bigint"))


#: Most events of one file of arrivals, about.
FILE_ROWS = 1_000_000


def arrivals(spark: SparkSession, df: DataFrame, parts: int = 3) -> DataFrame:
    """``df`` (with ``ts``) as a stream that brings it in ``parts`` triggers in time order and ends with an empty event a month later, which moves the watermark past all others."""
    df, path, t = materialize(df, "events"), scratch(spark, "arrivals"), F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = df.agg(F.percentile_approx(t, [i / parts for i in range(1, parts)]).alias("c"), F.max("ts").alias("end"), F.count("*").alias("n")).first()
    edges = [None, *(cuts["c"] or []), None]
    files = max(1, round(cuts["n"] / parts / FILE_ROWS))
    for lo, hi in zip(edges, edges[1:]):
        df.where((F.lit(True) if lo is None else t >= lo) & (F.lit(True) if hi is None else t < hi)).repartition(files).write.mode("append").parquet(path)
    closing = [F.lit(cuts["end"]).cast("timestamp") + F.expr("interval 30 days")]
    spark.range(1).select(*[(closing[0] if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rolling_dedupe(stream: DataFrame, window: int = 86_400, late: str = "1 hour") -> DataFrame:
    """(user_id, job_id, kept): the rolling dedupe as a keyed stateful operator.

    A key's state holds the last kept instant and those the watermark has not passed; it is dropped once no event can fall into the window of its last one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last = json.loads(state.get[0]) if state.exists else ([], None)
        if not state.hasTimedOut:
            pending += [int(s) for b in batches for s in b["s"]]
        passed, kept = state.getCurrentWatermarkMs() // 1000, []
        for s in sorted(s for s in pending if s < passed):
            if last is None or last < s - window:
                kept.append(s)
                last = s
        pending = [s for s in pending if s >= passed]
        if pending or last is not None and last + window >= passed:
            state.update((json.dumps((pending, last)),))
            state.setTimeoutTimestamp(max((min(pending) + 1 if pending else last + window + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "job_id": [key[1]] * len(kept), "kept": kept})

    x = stream.withWatermark("ts", late).withColumn("s", F.unix_timestamp("ts"))
    return x.groupBy("user_id", "job_id").applyInPandasWithState(step, "user_id bigint, job_id bigint, kept bigint", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def render_skips(stream: DataFrame, render: list[str], over: int, late: str = "1 hour", item: str = "job_id", rank: str = "rank", event: str = "ev", event_id: str = "event_id") -> DataFrame:
    """(event_id) of derived skips, keyed by render: a render's events are held until the watermark is ``over`` seconds past its latest one.

    A session window per render, without Python, since there are about as many renders as events; events of one render that are ``over`` seconds apart count as two renders.
    """
    # a filter here would be pushed below the watermark, which must see every event's time
    x = stream.withWatermark("ts", late)
    x = x.select(*render, F.col(item).cast("bigint").alias("i"), F.col(rank).cast("bigint").alias("r"), F.col(event).alias("e"), F.col(event_id).cast("bigint").alias("x"), "ts")
    whole = F.col("i").isNotNull() & F.col("r").isNotNull() & F.col("e").isNotNull() & F.col("x").isNotNull()
    opened = F.max(F.when(whole & (F.col("e") == "open"), F.col("r"))).alias("opened")
    shown = F.collect_list(F.when(whole & (F.col("e") == "impression"), F.struct("i", "r", "x"))).alias("shown")
    touched = F.collect_set(F.when(whole & (F.col("e") != "impression"), F.col("i"))).alias("touched")
    held = x.groupBy(*render, F.session_window("ts", f"{over} seconds")).agg(opened, shown, touched)
    skips = F.filter("shown", lambda s: (s["r"] < F.col("opened")) & ~F.array_contains("touched", s["i"]))
    return held.select(F.explode(skips).alias("s")).select(F.col("s.x").alias("event_id"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all that is there, once, into a table in the shared folder."""
    spark = stream.sparkSession
    out, marks = scratch(spark, name), scratch(spark, f"{name}-marks")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n) of tumbling windows; later events than ``late`` behind the newest are dropped."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")
