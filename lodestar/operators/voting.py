"""Votes over several passes of one extraction, self-consistency of repeats, ordering reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import folds, stats


def voted(passes: DataFrame, key: str, order: str, enums: Sequence[str], numbers: Sequence[str], prose: str) -> DataFrame:
    """One row per key: enums by first mode, numbers by lower median, prose from the pass that agrees with most voted enums (the first of equals), and the share of unanimous fields (null for one pass)."""
    out = None
    for f in enums:
        m = folds.first_mode(passes, [key], f, order).withColumnRenamed("mode", f)
        out = m if out is None else out.join(m, key)
    g = passes.groupBy(key).agg(*[folds.lower_median(F.col(f)).alias(f) for f in numbers], *[F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f"__k_{f}") for f in [*enums, *numbers]], F.count("*").alias("passes"))
    out = out.join(g, key)
    best = passes.select(key, order, prose, *[F.col(f).alias(f"__{f}") for f in enums]).join(out.select(key, *enums), key)
    hits = sum((F.col(f"__{f}").eqNullSafe(F.col(f)).cast("int") for f in enums), F.lit(0))
    best = best.groupBy(key).agg(F.max_by(prose, F.struct(hits, -F.col(order))).alias(prose))
    same = sum(((F.col(f"__k_{f}") == 1).cast("int") for f in [*enums, *numbers]), F.lit(0))
    share = F.when(F.col("passes") > 1, same / float(len(enums) + len(numbers)))
    return out.join(best, key).select(key, *enums, *numbers, prose, "passes", share.alias("unanimity"))


def self_consistency(repeats: DataFrame, record: str, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, field, records, stable, low, high): share of records whose repeats all give one value, with its interval."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("\0")).alias("v")) for f in fields]))
    x = repeats.select(record, *by, pairs.alias("x")).select(record, *by, "x.field", "x.v")
    r = x.groupBy(record, *by, "field").agg((F.countDistinct("v") == 1).alias("one"), F.count("*").alias("n")).where("n > 1")
    g = r.groupBy(*by, "field").agg(F.count("*").alias("records"), F.count_if("one").alias("stable"))
    low, high = stats.wilson(F.col("stable"), F.col("records"))
    return g.withColumn("low", low).withColumn("high", high)


def interpretable(floor: DataFrame, ceiling: DataFrame, measured: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, floor, ceiling, measured): refuses to be built when a measured cell lacks its floor or ceiling."""
    j = measured.select(*on, F.col("value").alias("measured")).join(floor.select(*on, F.col("value").alias("floor")), list(on), "left").join(ceiling.select(*on, F.col("value").alias("ceiling")), list(on), "left")
    if j.where("floor is null or ceiling is null or measured is null").limit(1).count():
        raise ValueError("a measured cell lacks its floor or ceiling")
    return j.select(*on, "floor", "ceiling", "measured")


def ordering_report(rows: DataFrame, stratum: str, score: str, label: str, k: int, unranked: Sequence[str] = ()) -> DataFrame:
    """(stratum, positives, expected, precision, low, high): ranking quality per stratum; strata that were never ranked have no order."""
    ap = stats.average_precision(rows, [stratum], score, label).select(stratum, "positives", "expected")
    p = stats.precision_at(rows, [stratum], score, label, k)
    n = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    low, high = stats.wilson(F.col("positives"), F.col("n"))
    x = n.join(ap, stratum, "left").join(p, stratum, "left").na.fill(0, ["positives"])
    ranked = ~F.col(stratum).isin(*unranked) if unranked else F.lit(True)
    return x.select(stratum, "positives", F.when(ranked, F.col("expected")).alias("expected"), F.when(ranked, F.col("precision")).alias("precision"), low.alias("low"), high.alias("high"))


def pooled_rate(cells: DataFrame, keys: Sequence[str], k: str, n: str) -> DataFrame:
    """(keys, k, n, rate, low, high): rates pooled over cells with their interval."""
    g = cells.groupBy(*keys).agg(F.sum(k).alias("k"), F.sum(n).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.withColumn("rate", F.try_divide("k", "n")).withColumn("low", low).withColumn("high", high)


def as_set(c: Column) -> Column:
    """Sorted set of a JSON list, or of the text itself where it is none."""
    return F.array_sort(F.array_distinct(F.coalesce(F.from_json(c, "array<string>"), F.array(c))))
