"""Folds of logs and groups whose rules differ from the built-in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key with the columns of its latest row; summed map-side, no window over the whole key."""
    s = F.struct(*[F.col(c) for c in [*order, *keep]])
    return rows.groupBy(*keys).agg(F.max(s).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in keep])


def bucket(n: Column, least: int, bounds: Sequence[tuple[int, str]], rest: str) -> Column:
    """Privacy bucket of a count; null below ``least``."""
    out = F.when(n < least, F.lit(None).cast("string"))
    for bound, label in bounds:
        out = out.when(n <= bound, label)
    return out.otherwise(rest)


#: Fixed values of the two signals.
def saver_bucket(n: Column) -> Column:
    return bucket(n, 3, [(5, "3-5"), (10, "6-10")], "10+")


def watcher_bucket(n: Column) -> Column:
    return bucket(n, 4, [(6, "4-6"), (10, "7-10")], "11+")


def first_mode(rows: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """(keys, mode): the most frequent value; of equally frequent ones the one seen first."""
    g = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    return g.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("p"))).alias("mode"))


def only_mode(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, mode): the most frequent value; null where several are equally frequent."""
    g = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = g.groupBy(*keys).agg(F.max("n").alias("m"))
    x = g.join(top, list(keys)).where("n = m")
    return x.groupBy(*keys).agg(F.when(F.count("*") == 1, F.max(value)).alias("mode"))


def lower_median(value: Column) -> Column:
    """Aggregate: null unless more than half the values are known; the lower one of two middle values."""
    known = F.array_sort(F.array_agg(value))
    n = F.size(known)
    return F.when(n * 2 > F.count("*"), F.element_at(known, (F.floor((n - 1) / 2) + 1).cast("int")))


def ordered_distinct(array: Column) -> Column:
    """Case-insensitive distinct of a list that keeps the first spelling and the order."""
    seen = F.transform(array, lambda x: F.lower(x))
    return F.filter(array, lambda x, i: F.array_position(seen, F.lower(x)) == i + 1)
