"""Term statistics over short texts: TF-IDF, sparse cosine, discriminating terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import materialize


def terms(rows: DataFrame, key: str, text: str, pattern: str = r"[a-z][a-z0-9+#.\-]{1,}", stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, term): tokens of more than two characters, with repeats, without stop words."""
    t = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return rows.select(key, F.explode(t).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*stop) if stop else F.length("term") > 2)


def tfidf(tokens: DataFrame, key: str, min_df: int = 2, max_share: float = 0.5) -> DataFrame:
    """(key, term, w): (1 + ln tf) * ln(n / df), each document normalised to length 1."""
    tf = tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = tokens.agg(F.countDistinct(key).alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    x = tf.join(df, "term").withColumn("raw", (1 + F.log("tf")) * F.log(F.col("n") / F.col("df")))
    # summed in the order of the terms, so that documents of equal terms have equal vectors to the last bit
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key).orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.select(key, "term", F.try_divide(F.col("raw"), norm).alias("w"))


#: Most keys of one block of documents with equal vectors; pairs are written out block by block.
BLOCK = 512


def cosine_pairs(vectors: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b, sim), a < b: pairs with at least this cosine; only terms in a vector's heavy prefix are joined first.

    Documents with equal vectors are compared as one and written out as pairs at the end, in blocks, so that the
    joins grow with the number of different vectors. Terms are ordered rarest first; a pair whose first shared term
    leaves too little of either vector cannot reach ``least``, so common terms drop out of the join without being capped.
    """
    packed = vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("vec"))
    named = materialize(packed.withColumn("g", F.first(key).over(Window.partitionBy("vec").orderBy(key))), "vectors")
    v = named.where(F.col(key) == F.col("g")).select("g", F.explode("vec").alias("x")).select("g", "x.term", "x.w")
    v = materialize(v, "different")
    df = v.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("g").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(w), F.lit(0.0))))
    p = v.join(df, "term").withColumn("left", left).where(F.col("left") >= least - 1e-9)
    a, b = p.select(F.col("g").alias("ga"), "term", F.col("left").alias("la")), p.select(F.col("g").alias("gb"), "term", F.col("left").alias("lb"))
    near = a.join(b, "term").where((F.col("ga") < F.col("gb")) & (F.col("la") * F.col("lb") >= least - 1e-9)).select("ga", "gb").distinct()
    va, vb = v.select(F.col("g").alias("ga"), "term", F.col("w").alias("wa")), v.select(F.col("g").alias("gb"), "term", F.col("w").alias("wb"))
    close = near.join(va, "ga").join(vb, ["gb", "term"]).groupBy("ga", "gb").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    several = named.groupBy("g").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    same = v.join(several.where("n > 1"), "g").groupBy("g").agg(F.sum(F.col("w") * F.col("w")).alias("sim")).select(F.col("g").alias("ga"), F.col("g").alias("gb"), "sim")
    close = close.unionByName(same).where(F.col("sim") >= least)
    blocks = named.join(several, "g").groupBy("g", F.pmod(F.xxhash64(key), "blocks").alias("block")).agg(F.collect_list(key).alias("keys"))
    blocks = materialize(blocks, "blocks")
    x = close.join(blocks.select(F.col("g").alias("ga"), F.col("block").alias("i"), F.col("keys").alias("x")), "ga")
    x = x.join(blocks.select(F.col("g").alias("gb"), F.col("block").alias("j"), F.col("keys").alias("y")), "gb").where("ga <> gb or i <= j")
    # spread by block pair: one task would otherwise write all pairs of the few largest groups
    x = x.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ga", "gb", "i", "j")
    x = x.select("sim", F.col("ga") == F.col("gb"), "i", "j", F.explode("x").alias("x"), "y").toDF("sim", "same", "i", "j", "x", "y")
    x = x.select("sim", "same", "i", "j", "x", F.explode("y").alias("y")).where("not same or i < j or x < y")
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def discriminating_terms(tokens: DataFrame, key: str, group: str, least_ratio: float = 2.0) -> DataFrame:
    """(group, term, inside, score): terms over ``least_ratio`` times as frequent in a group's documents as in all; score (p_in - p_all) * ln(1 + c)."""
    d = tokens.select(key, group, "term").distinct()
    n_all = d.agg(F.countDistinct(key).alias("n_all"))
    sizes = d.groupBy(group).agg(F.countDistinct(key).alias("n_in"))
    inside = d.groupBy(group, "term").agg(F.count("*").alias("inside"))
    overall = d.groupBy("term").agg(F.countDistinct(key).alias("c_all"))
    x = inside.join(overall, "term").join(F.broadcast(sizes), group).crossJoin(F.broadcast(n_all))
    p_in, p_all = F.col("inside") / F.col("n_in"), F.col("c_all") / F.col("n_all")
    return x.where(p_in > least_ratio * p_all).select(group, "term", "inside", ((p_in - p_all) * F.log(1 + F.col("inside"))).alias("score"))
