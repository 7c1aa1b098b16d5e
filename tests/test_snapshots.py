"""Snapshot changes against a brute-force comparison of consecutive deliveries."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestar.operators.snapshots import change_events, instant, plain, row_hash, validity_intervals

SCHEMA = "snapshot_no int, id string, loaded_at timestamp, content_hash string, closed_at string"
T0 = dt.datetime(2026, 1, 1)


def digest():
    return row_hash([plain(F.col("content_hash")), instant(F.col("closed_at"))])


def events(spark, rows):
    return sorted(tuple(r) for r in change_events(spark.createDataFrame(rows, SCHEMA), digest()).collect())


def brute(rows):
    state = {}
    for no, key, at, h, _ in sorted((r for r in rows if r[1] is not None and r[0] is not None), key=lambda r: r[2]):
        state.setdefault(no, {})[key] = h
    out, nos = [], sorted(state)
    for a, b in zip(nos, nos[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.append((b, k, "added"))
            elif k not in state[b]:
                out.append((b, k, "removed"))
            elif state[a][k] != state[b][k]:
                out.append((b, k, "changed"))
    return sorted(out)


def test_random_histories(spark):
    rng = random.Random(3)
    rows = []
    for no in (1, 2, 3, 5, 8):
        for k in range(60):
            if rng.random() < 0.7:
                for n in range(rng.choice([1, 1, 2])):
                    rows.append((no, f"k{k}", T0 + dt.timedelta(days=no, seconds=k * 10 + n), rng.choice("ab"), None))
    assert events(spark, rows) == brute(rows)


def test_writing_is_no_change(spark):
    base = [(1, "a", T0, "AB", "2026-01-01T00:00:00"), (2, "a", T0, " ab", "2026-01-01 00:00:00"), (3, "a", T0, "ab ", "2026-01-01T02:00:00+02:00"), (4, "a", T0, "ab", "2026-01-01T00:00:00Z")]
    assert events(spark, base) == []
    assert events(spark, base + [(5, "a", T0, "ab", None)]) == [(5, "a", "changed")]
    assert events(spark, [(1, "a", T0, None, ""), (2, "a", T0, None, None), (3, "a", T0, "", "odd"), (4, "a", T0, "", "ODD")]) == [(3, "a", "changed")]


def test_null_keys_repeats_and_empty(spark):
    rows = [(1, "a", T0, "x", None)] * 3 + [(1, None, T0, "x", None), (None, "b", T0, "x", None), (2, "a", T0, "x", None)]
    assert events(spark, rows) == []
    assert events(spark, []) == []


def test_intervals(spark):
    rows = [(n, "a", T0, h, None) for n, h in ((1, "x"), (2, "x"), (3, "y"), (7, "y"))] + [(n, "b", T0, "z", None) for n in (1, 3, 7)] + [(2, "c", T0, "q", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.lit(9)).withColumn("h", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted((r.key, r.from_ord, r.to_ord) for r in validity_intervals(df, digest()).collect())
    assert got == [("a", 1, 2), ("a", 3, 4), ("b", 1, 1), ("b", 3, 4), ("c", 2, 2)]
