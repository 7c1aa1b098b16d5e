"""Queries of the general training-data operators (problems 2, 4 and 5), with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.operators import snapshots, timestamps, units


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.normalize_timestamps(table(spark, folder, "jobs"), table(spark, folder, "platforms"))


def p2_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.mask_profile(table(spark, folder, "jobs"), "posted_at")


def p2_unknown_zones(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.unknown_zones(table(spark, folder, "jobs"), table(spark, folder, "platforms"))


def snapshot_hash():
    """Row hash of a posting: its content hash and closing instant, however written."""
    return snapshots.row_hash([snapshots.plain(F.col("content_hash")), snapshots.instant(F.col("closed_at"))])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.change_events(table(spark, folder, "job_snapshots"), snapshot_hash())


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    iv = snapshots.validity_intervals(table(spark, folder, "job_snapshots"), snapshot_hash())
    return iv.select(F.col("key").alias("id"), F.col("from_ord").cast("bigint").alias("from_ord"), F.col("to_ord").cast("bigint").alias("to_ord"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.yearly_pay(table(spark, folder, "jobs_app"), table(spark, folder, "fx_rates"), table(spark, folder, "pay_units"))


QUERIES = {f.__name__: f for f in (p2_found, p2_shapes, p2_unknown_zones, p4_found, p4_intervals, p5_found)}

_HELD = r"""
WITH rows AS (
  SELECT snapshot_no, id, nullif(lower(trim(content_hash)), '') AS h,
         CAST(CASE WHEN regexp_matches(trim(closed_at), '([zZ]|[+-]\d{2}:?\d{2})$') THEN trim(closed_at) ELSE trim(closed_at) || 'Z' END AS TIMESTAMPTZ) AS c,
         row_number() OVER (PARTITION BY snapshot_no, id ORDER BY loaded_at DESC) AS rn
  FROM job_snapshots WHERE id IS NOT NULL AND snapshot_no IS NOT NULL),
held AS (SELECT r.snapshot_no, r.id, r.h, r.c, n.ord FROM rows r
  JOIN (SELECT snapshot_no, dense_rank() OVER (ORDER BY snapshot_no) AS ord FROM (SELECT DISTINCT snapshot_no FROM job_snapshots)) n USING (snapshot_no) WHERE rn = 1)
"""

ORACLE = {
    "p2_shapes": r"""
SELECT regexp_replace(regexp_replace(regexp_replace(trim(posted_at), '\p{N}', '9', 'g'), '\p{L}+', 'a', 'g'), '\s+', ' ', 'g') AS mask, count(*) AS "values"
FROM jobs WHERE posted_at IS NOT NULL GROUP BY 1""",
    "p2_unknown_zones": """
SELECT j.platform, p.tz_name, count(*) AS "values" FROM jobs j LEFT JOIN platforms p USING (platform)
WHERE j.posted_at IS NOT NULL AND (p.tz_name IS NULL OR p.tz_name NOT IN (SELECT name FROM pg_timezone_names())) GROUP BY 1, 2""",
    "p4_found": _HELD
    + """
, nos AS (SELECT DISTINCT snapshot_no, ord FROM held),
pairs AS (
  SELECT coalesce(a.id, b.id) AS id, coalesce(a.ord, b.ord + 1) AS ord, a.id IS NULL AS gone, b.id IS NULL AS fresh,
         a.h IS DISTINCT FROM b.h OR a.c IS DISTINCT FROM b.c AS differs
  FROM held a FULL JOIN held b ON a.id = b.id AND a.ord = b.ord + 1)
SELECT nos.snapshot_no, id, CASE WHEN gone THEN 'removed' WHEN fresh THEN 'added' ELSE 'changed' END AS change_kind
FROM pairs JOIN nos USING (ord) WHERE ord > 1 AND (gone OR fresh OR differs)""",
    "p4_intervals": _HELD
    + """
, marked AS (SELECT id, ord, CASE WHEN lag(ord) OVER w = ord - 1 AND lag(h) OVER w IS NOT DISTINCT FROM h AND lag(c) OVER w IS NOT DISTINCT FROM c THEN 0 ELSE 1 END AS fresh
  FROM held WINDOW w AS (PARTITION BY id ORDER BY ord)),
runs AS (SELECT id, ord, sum(fresh) OVER (PARTITION BY id ORDER BY ord) AS run FROM marked)
SELECT id, CAST(min(ord) AS BIGINT) AS from_ord, CAST(max(ord) AS BIGINT) AS to_ord FROM runs GROUP BY id, run""",
}
