"""Incremental core: change-detecting merge, closing, re-keying, versioned recompute. Parquet is rewritten, never updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_verdicts(stored: DataFrame, batch: DataFrame, key: str, digest: str, is_open: Column) -> DataFrame:
    """(key, verdict): new, updated, unchanged or absent. A closed row that reappears is updated even if equal.

    ``is_open`` is over the stored row. One full outer join on the key decides all verdicts.
    """
    s = stored.select(key, F.col(digest).alias("__s"), is_open.alias("__open"), F.lit(True).alias("__has"))
    b = batch.select(key, F.col(digest).alias("__b"), F.lit(True).alias("__got"))
    same = F.col("__s").eqNullSafe(F.col("__b")) & F.coalesce(F.col("__open"), F.lit(False))
    v = F.when(F.col("__has").isNull(), "new").when(F.col("__got").isNull(), "absent").when(same, "unchanged").otherwise("updated")
    return s.join(b, key, "full_outer").select(key, v.alias("verdict"))


def merged(stored: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], sticky: Sequence[str] = (), first: str = "first_seen", last: str = "last_seen", status: str = "status", closed: str = "closed_at") -> DataFrame:
    """The table after merging a batch: batch values win but for ``sticky`` columns of rows that exist; ``first`` is kept, ``last`` moved, closed rows reopened.

    Whether a stored row exists decides, so a stored null of a sticky column stays null.
    """
    s, b = stored.withColumn("__has", F.lit(True)).alias("s"), batch.withColumn("__got", F.lit(True)).alias("b")
    j = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    got, has = F.col("b.__got").isNotNull(), F.col("s.__has").isNotNull()
    out = [F.coalesce(F.col(f"s.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in columns:
        stay = has if c in sticky else ~got
        out.append(F.when(stay, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    out.append(F.coalesce(F.col(f"s.{first}"), F.col(f"b.{last}")).alias(first))
    out.append(F.when(got, F.col(f"b.{last}")).otherwise(F.col(f"s.{last}")).alias(last))
    out.append(F.when(got, F.lit("open")).otherwise(F.col(f"s.{status}")).alias(status))
    out.append(F.when(~got, F.col(f"s.{closed}")).alias(closed))
    return j.select(*out)


def error_rate_exceeded(errors: Column, attempted: Column, threshold: float = 0.05) -> Column:
    """Whether the share of errors is strictly over the threshold; no errors never are."""
    return F.coalesce((errors > 0) & (errors / F.nullif(attempted, F.lit(0)) > threshold), F.lit(False))


def close_missing(stored: DataFrame, seen: DataFrame, key: str, complete: bool, now: Column) -> DataFrame:
    """``stored`` with open rows that a complete delivery left out closed; an incomplete or empty one closes nothing."""
    if not complete or seen.limit(1).count() == 0:
        return stored
    s = seen.select(key).distinct().withColumn("__seen", F.lit(True))
    gone = F.col("__seen").isNull() & (F.col("status") == "open")
    return stored.join(s, key, "left").withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at"))).withColumn("status", F.when(gone, "closed").otherwise(F.col("status"))).drop("__seen")


def rekeyed(rows: DataFrame, old: str, new: Column, order: Sequence[str], keep_max: str, keep_min: str) -> DataFrame:
    """(new_id, survivor, merged, first, last): groups of rows whose recomputed id is the same; the latest row survives."""
    g = rows.withColumn("new_id", new)
    return g.groupBy("new_id").agg(F.max(F.struct(*order, old)).getField(old).alias("survivor"), F.count("*").alias("merged"), F.min(keep_min).alias("first"), F.max(keep_max).alias("last"))


def recompute_verdicts(facts: DataFrame, stored: DataFrame, key: str, versions: Sequence[str], score: Column, floor: int) -> DataFrame:
    """(key, action): skip (same versions), write, demote (stored, now under the floor), ignore (never stored, under it), prune (no longer scoreable)."""
    s = stored.select(key, *[F.col(v).alias(f"__{v}") for v in versions], F.lit(True).alias("__has"))
    f = facts.select(key, *versions, score.alias("__score"), F.lit(True).alias("__got"))
    same = F.col("__has")
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    action = F.when(F.col("__got").isNull(), "prune").when(F.coalesce(same, F.lit(False)), "skip").when(F.col("__score") >= floor, "write").when(F.col("__has"), "demote").otherwise("ignore")
    return f.join(s, key, "full_outer").select(key, action.alias("action"))
