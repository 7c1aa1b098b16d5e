"""Streams equal their batch forms however events are spread over triggers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import eventlog
from lodestar.streaming import engagement as E

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, job_id bigint, rank int, ev string, day date"
T0 = dt.datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module")
def events():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        at = T0 + dt.timedelta(minutes=rng.randrange(4 * 24 * 60))
        rows.append((i, at, rng.randrange(3), rng.randrange(4), rng.randrange(1, 9), rng.choice(["impression"] * 4 + ["open"]), at.date()))
    return sorted(rows, key=lambda r: r[1])


def stream(spark, tmp_path, rows, cuts):
    """Rows in files of their own triggers, up to 30 minutes out of order between neighbours, and a last one that closes all."""
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for k in range(len(parts) - 1):
        near = [r for r in parts[k] if parts[k + 1] and (parts[k + 1][0][1] - r[1]).total_seconds() < 1800]
        parts[k] = [r for r in parts[k] if r not in near]
        parts[k + 1] = near + parts[k + 1]
    closing = (None, rows[-1][1] + dt.timedelta(days=30), None, None, None, None, None)
    for p in [*parts, [closing]]:
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_dedupe_over_triggers(spark, tmp_path, events):
    got = sorted(tuple(r) for r in E.run_available(E.rolling_dedupe(stream(spark, tmp_path, events, [40, 41, 80])), "d").collect())
    df = spark.createDataFrame(events, SCHEMA)
    want = eventlog.rolling_kept(df, ["user_id", "job_id"], F.unix_timestamp("ts"), 86_400)
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 10


def test_renders_over_triggers(spark, tmp_path, events):
    got = sorted(r[0] for r in E.run_available(E.render_skips(stream(spark, tmp_path, events, [35, 70]), ["user_id", "day"], 86_400), "s").collect())
    want = eventlog.derived_skips(spark.createDataFrame(events, SCHEMA), ["user_id", "day"], "job_id", "rank", "ev")
    assert got == sorted(r.event_id for r in want.collect()) and got


def test_windows_over_triggers(spark, tmp_path, events):
    s = stream(spark, tmp_path, events, [50]).withColumn("event_type", F.col("ev"))
    got = {(r.start, r.event_type): r.n for r in E.run_available(E.windowed_counts(s), "w").collect()}
    want = {}
    for r in events:
        k = (r[1].replace(minute=0), r[5])
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_renders_need_no_python(spark, events, monkeypatch):
    monkeypatch.setattr(E, "FILE_ROWS", 30)
    more = [(1000 * u + r[0], r[1], 10 * u + r[2], *r[3:]) for u in range(20) for r in events] + [(9, events[5][1], 1, None, 3, "open", events[5][6])]
    df = spark.createDataFrame(more, SCHEMA)
    skips = E.render_skips(E.arrivals(spark, df), ["user_id", "day"], 86_400)
    plan = skips._jdf.queryExecution().logical().toString().lower()
    assert "session" in plan and "python" not in plan and "pandas" not in plan
    got = sorted(r.event_id for r in E.run_available(skips, "s").collect())
    want = eventlog.derived_skips(df.dropna(), ["user_id", "day"], "job_id", "rank", "ev")
    assert got == sorted(r.event_id for r in want.collect()) and len(got) > 100
