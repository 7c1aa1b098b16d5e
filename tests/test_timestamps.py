"""Timestamp normalisation against hand-computed instants and java-free brute force."""

import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from lodestar.functions import zones
from lodestar.operators.timestamps import days_from_civil, mask_profile, normalize_timestamps, unknown_zones

SCHEMA = "id string, platform string, posted_at string, first_seen string"
PLATFORMS = [("us", "America/New_York", False), ("de", "Europe/Berlin", True), ("in", "Asia/Kolkata", True)]


def run(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], SCHEMA)
    p = spark.createDataFrame(PLATFORMS, "platform string, tz_name string, day_first boolean")
    return {(r.id, r.field_name): r.utc_seconds for r in normalize_timestamps(df, p).collect()}


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize(
    "platform, text, want",
    [
        ("us", "2026-01-05T10:00:00", utc(2026, 1, 5, 15)),
        ("us", "2026-01-05T10:00:00.999999Z", utc(2026, 1, 5, 10)),
        ("us", "2026-01-05 10:00 CST", utc(2026, 1, 5, 16)),
        ("us", "03/04/2026 1:30 PM", utc(2026, 3, 4, 18, 30)),
        ("de", "03/04/2026 13:30", utc(2026, 4, 3, 11, 30)),
        ("de", "3.4.2026, 13:30:07", utc(2026, 4, 3, 11, 30, 7)),
        ("us", "April 9, 2026 12:05 am", utc(2026, 4, 9, 4, 5)),
        ("in", "Fri, 01 May 2026 05:08:37 +0530", utc(2026, 4, 30, 23, 38, 37)),
        ("us", "20260102T030405Z", utc(2026, 1, 2, 3, 4, 5)),
        ("us", "1767225600", 1767225600),
        ("us", "1767225600999", 1767225600),
        ("us", "2026-01-05", utc(2026, 1, 5, 5)),
        ("us", "2026-03-08T02:30:00", utc(2026, 3, 8, 7, 30)),  # skipped: forward by the gap
        ("us", "2026-11-01T01:30:00", utc(2026, 11, 1, 5, 30)),  # occurs twice: the first
        ("us", "Reposted An Hour Ago", utc(2026, 6, 10, 1)),
        ("us", "3 days ago", utc(2026, 6, 7, 2)),
        ("us", "posted today", utc(2026, 6, 9, 4)),  # 02:00 UTC is the evening of the 9th there
        ("us", "Yesterday", utc(2026, 6, 8, 4)),
    ],
)
def test_values(spark, platform, text, want):
    assert run(spark, [(platform, text, "2026-06-10T02:00:00")])["0", "posted_at"] == want


def test_no_instant(spark):
    bad = ["30+ days ago", "", "  ", "n/a", "2026-13-40", "0000-00-00", "2026-02-30T10:00:00", "25:00", "x" * 50_000, None]
    assert run(spark, [("us", b, None) for b in bad]) == {}
    assert run(spark, [("nowhere", "2026-01-05T10:00:00", None), (None, "2026-01-05", None)]) == {}
    assert run(spark, [("us", "3 days ago", "bad")]) == {}


def test_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "us", "2026-01-05T10:00:00Z", None)] * 3, SCHEMA).selectExpr("*", "'x' as k", "'y' as tz_name", "1 as w", "2 as utc_seconds")
    p = spark.createDataFrame(PLATFORMS, "platform string, tz_name string, day_first boolean").selectExpr("*", "'q' as id")
    assert [tuple(r) for r in normalize_timestamps(df, p).collect()] == [("a", "posted_at", utc(2026, 1, 5, 10))]
    assert normalize_timestamps(df.limit(0), p).count() == 0
    assert mask_profile(df, "posted_at").collect()[0][:] == ("9999-99-99a99:99:99a", 3)


@pytest.mark.parametrize("name", ["America/New_York", "Australia/Sydney", "Europe/London", "Asia/Kolkata", "America/St_Johns"])
def test_zone_tables_equal_the_database(name):
    t, z = zones.build(name), ZoneInfo(name)
    rng = np.random.default_rng(1)
    wall = rng.integers(0, 2_500_000_000, 3000)
    want = []
    for w in wall:
        local = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(w))
        want.append(int(w) - int(local.replace(tzinfo=z, fold=0).utcoffset().total_seconds()))
    assert t.to_utc(wall).tolist() == want


def test_civil_days():
    y = np.array([1970, 2000, 2026, 2026, 2024, 2023])
    m = np.array([1, 2, 13, 4, 2, 2])
    d = np.array([1, 29, 1, 31, 29, 29])
    got = days_from_civil(y, m, d)
    assert got[0] == 0 and got[1] == 11016 and (got[[2, 3, 5]] < -(10**12)).all() and got[4] == 19782


def test_unknown_zones_are_reported(spark):
    df = spark.createDataFrame([("1", "mars", "2026-01-05T10:00:00", None), ("2", "mars", "2026-01-05T10:00:00Z", None), ("3", "us", "2026-01-05T10:00:00", None), ("4", "none", "2026-01-05", None), ("5", "mars", None, None)], SCHEMA)
    p = spark.createDataFrame([("us", "America/New_York", False), ("mars", "Mars/Base", False)], "platform string, tz_name string, day_first boolean")
    with pytest.warns(UserWarning, match="Mars/Base"):
        got = {r.id: r.utc_seconds for r in normalize_timestamps(df, p).collect()}
    assert got == {"2": utc(2026, 1, 5, 10), "3": utc(2026, 1, 5, 15)}
    with pytest.warns(UserWarning):
        assert sorted(tuple(r) for r in unknown_zones(df, p).collect()) == [("mars", "Mars/Base", 2), ("none", None, 1)]


def test_a_mask_is_asked_again_for_other_values(spark):
    got = run(spark, [("us", "seen 5 odd 2026", None), ("us", "Jan 5 odd 2026", None), ("us", "2026-01-05 10:00", None), ("us", "2026-01-05 10:00", None)])
    assert {k[0] for k in got if k[1] == "posted_at"} >= {"2", "3"}
