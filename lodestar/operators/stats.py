"""Statistics of rankings, labels and rates as DataFrame operators, ties handled exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 97.5 % quantile of the standard normal distribution.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a rate; (0, 1) without observations, clamped to it otherwise."""
    p, d = F.try_divide(k.cast("double"), n.cast("double")), 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def average_rank(keys: Sequence[str], order: Column) -> Column:
    """Rank in which ties share their mean."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, order)) - 1) / 2.0


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): rank correlation of pairs without nulls; null for fewer than two or no variance."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = r.withColumn("__x", average_rank(keys, F.col(x))).withColumn("__y", average_rank(keys, F.col(y)))
    ok = (F.count("*") >= 2) & (F.stddev_pop("__x") > 0) & (F.stddev_pop("__y") > 0)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.when(ok, F.corr("__x", "__y")).alias("rho"))


def tie_blocks(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """(keys, score, size, hits, above, hits_above): blocks of equal scores, best first."""
    b = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("size"), F.sum(F.col(label).cast("int")).alias("hits"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("above", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("hits_above", F.coalesce(F.sum("hits").over(w), F.lit(0)))


def average_precision(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """(keys, positives, expected, optimistic, pessimistic): average precision over all orders of tied rows.

    Within a block of ``s`` rows with ``h`` hits, position i is a hit with probability h/s and then has, on
    average, (i-1)(h-1)/(s-1) of the block's other hits before it.
    """
    b = tie_blocks(rows, keys, score, label)
    total = b.groupBy(*keys).agg(F.sum("hits").alias("positives"))
    b = b.where("hits > 0")
    i = F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i")
    x = b.select(*keys, "size", "hits", "above", "hits_above", i)
    at = F.col("above") + F.col("i")
    inside = F.when(F.col("size") > 1, (F.col("i") - 1) * (F.col("hits") - 1) / (F.col("size") - 1)).otherwise(0.0)
    expected = F.col("hits") / F.col("size") * (F.col("hits_above") + 1 + inside) / at
    best = F.when(F.col("i") <= F.col("hits"), (F.col("hits_above") + F.col("i")) / at).otherwise(0.0)
    tail = F.col("i") - (F.col("size") - F.col("hits"))
    worst = F.when(tail > 0, (F.col("hits_above") + tail) / at).otherwise(0.0)
    s = x.groupBy(*keys).agg(F.sum(expected).alias("e"), F.sum(best).alias("o"), F.sum(worst).alias("p"))
    j = total.join(s, list(keys), "left") if keys else total.crossJoin(s)
    n = F.col("positives")
    return j.select(*keys, "positives", *[F.when(n > 0, F.col(c) / n).alias(name) for c, name in (("e", "expected"), ("o", "optimistic"), ("p", "pessimistic"))])


def precision_at(rows: DataFrame, keys: Sequence[str], score: str, label: str, k: int) -> DataFrame:
    """(keys, precision): share of hits in the first k rows; a block across the cut counts in proportion."""
    b = tie_blocks(rows, keys, score, label)
    taken = F.least(F.col("size"), F.greatest(F.lit(0), F.lit(k) - F.col("above")))
    s = b.groupBy(*keys).agg(F.sum(taken * F.col("hits") / F.col("size")).alias("h"), F.sum(taken).alias("t"))
    return s.select(*keys, F.try_divide("h", "t").alias("precision"))


def tie_histogram(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, kinds, largest, p_tie): p_tie is the chance that two different rows tie."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    g = c.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max("c").alias("largest"), F.sum(F.col("c") * (F.col("c") - 1)).alias("__t"))
    return g.select(*keys, "n", "kinds", "largest", F.try_divide(F.col("__t").cast("double"), (F.col("n") * (F.col("n") - 1)).cast("double")).alias("p_tie"))


def top_overlap(rows: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """(overlap): share of the k best rows by ``a`` that are among the k best by ``b``; ties by key."""
    ta = rows.where(F.col(a).isNotNull()).orderBy(F.desc(a), key).limit(k).select(key)
    tb = rows.where(F.col(b).isNotNull()).orderBy(F.desc(b), key).limit(k).select(key)
    return ta.join(tb, key).agg((F.count("*") / F.lit(float(k))).alias("overlap"))


def agreement(answers: DataFrame, item: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, items, unanimous, pairwise): share of items with one answer, mean share of agreeing pairs; items need two answers."""
    c = answers.where(F.col(value).isNotNull()).groupBy(*by, *item, value).agg(F.count("*").alias("c"))
    i = c.groupBy(*by, *item).agg(F.sum("c").alias("m"), F.count("*").alias("kinds"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    pair = F.col("same") / (F.col("m") * (F.col("m") - 1))
    return i.groupBy(*by).agg(F.count("*").alias("items"), F.avg(F.when(F.col("kinds") == 1, 1.0).otherwise(0.0)).alias("unanimous"), F.avg(pair).alias("pairwise"))


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, draws: int = 2000, seed: int = 11) -> DataFrame:
    """(mean_delta, low, high, draws): bootstrap interval of the mean of a - b; both use the same resample.

    Each row's multiplicity in each draw is Poisson(1), drawn from a hash of (seed, draw, key): the
    resample needs no shuffle of rows and is the same on every cluster.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", key), F.lit(2**40)) + 0.5) / float(2**40)
    steps, acc, p = [], 0.0, 0.36787944117144233
    for k in range(9):
        acc += p
        steps.append((k, acc))
        p /= k + 1
    weight = F.lit(9)
    for k, edge in reversed(steps):
        weight = F.when(u < edge, k).otherwise(weight)
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, (F.col(a) - F.col(b)).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    per = x.withColumn("w", weight).groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    return per.agg(F.avg("m").alias("mean_delta"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("m").alias("draws"))


def verdict(low: Column, high: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(low.isNull() | high.isNull(), "undefined").when(low > 0, "better").when(high < 0, "worse").otherwise("not distinguishable")


def stability(rows: DataFrame, key: str, repeat: str, value: str, k: int, tolerances: Sequence[float] = (0, 5, 10)) -> DataFrame:
    """One row of how an ordering holds over repeats: mean and least rank correlation and top-k overlap over all pairs of
    repeats, mean and largest difference, and the share of records whose first two repeats lie within each tolerance.

    Top places go to the higher value, then the smaller key. Repeats are few: every pair of them is one group.
    """
    r = rows.select(key, repeat, value).where(F.col(value).isNotNull())
    top = r.withColumn("__n", F.row_number().over(Window.partitionBy(repeat).orderBy(F.desc(value), key))).select(key, repeat, value, (F.col("__n") <= k).alias("__top"))
    a, b = (top.select(key, F.col(repeat).alias(f"r{s}"), F.col(value).alias(f"v{s}"), F.col("__top").alias(f"t{s}")) for s in "ab")
    pairs = a.join(b, key).where("ra < rb").withColumn("__d", F.abs(F.col("va") - F.col("vb")))
    rho = spearman(pairs, ["ra", "rb"], "va", "vb").agg(F.avg("rho").alias("spearman_mean"), F.min("rho").alias("spearman_min"))
    over = pairs.groupBy("ra", "rb").agg((F.count_if(F.col("ta") & F.col("tb")) / float(k)).alias("o")).agg(F.avg("o").alias("overlap_mean"), F.min("o").alias("overlap_min"))
    first = top.groupBy().agg(F.min(repeat).alias("x"))
    diff = pairs.agg(F.avg("__d").alias("mean_abs_diff"), F.max("__d").alias("max_abs_diff"))
    second = top.join(F.broadcast(first), F.col(repeat) > F.col("x")).groupBy("x").agg(F.min(repeat).alias("y"))
    bands = pairs.join(F.broadcast(second), (F.col("ra") == F.col("x")) & (F.col("rb") == F.col("y"))).agg(*[F.avg((F.col("__d") <= t).cast("int")).alias(f"within_{t:g}") for t in tolerances])
    return rho.crossJoin(over).crossJoin(diff).crossJoin(bands)
