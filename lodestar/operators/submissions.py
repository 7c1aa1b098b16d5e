"""Contributed rows: parsing, settling of leases and watermarks, audit, validated writes, ledgered passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import bounded_rows

#: Most passes a ledger holds.
MAX_PASSES = 10_000


def parsed(raw: DataFrame, body: str, schema: str, required: list[str]) -> DataFrame:
    """``raw`` with the fields of its JSON ``body`` and ``accepted``: the text is an object of that schema with all required fields."""
    x = raw.withColumn("__p", F.from_json(body, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    ok = F.col("__p").isNotNull() & F.col("__p.__bad").isNull()
    for c in required:
        ok = ok & F.col(f"__p.{c}").isNotNull()
    fields = [f.name for f in x.schema["__p"].dataType.fields if f.name != "__bad"]
    return x.select("*", *[F.col(f"__p.{c}").alias(c) for c in fields], F.coalesce(ok, F.lit(False)).alias("accepted")).drop("__p")


def settled(state: DataFrame, requests: DataFrame, rows: DataFrame, now: Column, key: str = "dataset") -> DataFrame:
    """(key, watermark, holder, fetched, accepted, rejected, advanced, reason): the state after submissions.

    ``requests`` names the data sets submitted for, ``rows`` their :func:`parsed` rows. A submission releases its lease;
    the watermark moves to ``now`` only if rows came with it: an empty one says nothing about the window it was to cover.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("fetched"), F.count_if("accepted").alias("accepted"))
    x = state.join(requests.select(key).distinct().withColumn("__asked", F.lit(True)), key, "left").join(n, key, "left").na.fill(0, ["fetched", "accepted"])
    asked = F.coalesce(F.col("__asked"), F.lit(False))
    advanced = asked & (F.col("fetched") > 0)
    reason = F.when(asked & ~advanced, "empty submission")
    return x.select(key, F.when(advanced, now).otherwise(F.col("watermark")).alias("watermark"), F.when(~asked, F.col("holder")).alias("holder"), "fetched", "accepted", (F.col("fetched") - F.col("accepted")).alias("rejected"), advanced.alias("advanced"), reason.alias("reason"))


def append_audit(path: str, entries: DataFrame) -> DataFrame:
    """The log at ``path`` with ``entries`` appended; entries are only ever added."""
    entries.write.mode("append").parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def write_validated(df: DataFrame, path: str, checks: Mapping[str, Column]) -> DataFrame:
    """(reason, rows) of a write that loses no good row to a bad one: rows that pass every check lie below ``path``/ok, others,
    with the first check they fail, below ``path``/bad. A null result fails a check."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    x = df.withColumn("reason", reason)
    x.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{path}/ok")
    x.where("reason is not null").write.mode("overwrite").parquet(f"{path}/bad")
    spark = df.sparkSession
    good = spark.read.schema(df.schema).parquet(f"{path}/ok").agg(F.lit("written").alias("reason"), F.count("*").alias("rows"))
    return good.unionByName(spark.read.schema(x.schema).parquet(f"{path}/bad").groupBy("reason").agg(F.count("*").alias("rows")))


def run_passes(spark: SparkSession, ledger: str, passes: Mapping[str, Callable[[], None]]) -> DataFrame:
    """(pass, applied): runs the passes the ledger does not name, in order, and enters each one when it is through.

    A pass that fails stays out of the ledger, and so do those after it; the next run goes on with it.
    """
    schema, rows = "pass string", []
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    done = {r[0] for r in bounded_rows(spark.read.schema(schema).parquet(ledger), MAX_PASSES, "ledger")}
    for name, step in passes.items():
        if name not in done:
            step()
            spark.createDataFrame([(name,)], schema).write.mode("append").parquet(ledger)
        rows.append((name, name not in done))
    return spark.createDataFrame(rows, "pass string, applied boolean")
