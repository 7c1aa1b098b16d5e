"""Distributed graph steps: connected components and average-linkage clustering. No component is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import drop_path, scratch

#: Most rounds of components(); each at least halves what is left, so this is never reached on data that fits a disk; raised if it is.
MAX_ROUNDS = 64


def _kept(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder; the table it was made from is removed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    if old:
        drop_path(df.sparkSession, old)
    return df.sparkSession.read.parquet(path), path


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating large and small stars.

    Both steps attach nodes to the least neighbour, so a hub's edges move away from it instead of
    meeting in one task; the number of rounds grows with the logarithm of the longest chain.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    cur, path = _kept(both, "cc", None)
    for _ in range(MAX_ROUNDS):
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt, new_path = _kept(small, "cc", None)
        same = nxt.count() == cur.count() and nxt.exceptAll(cur).limit(1).count() == 0
        drop_path(cur.sparkSession, path)
        cur, path = nxt, new_path
        if same:
            break
    else:
        raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def _totals(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """(u, v, s, nu, nv): the summed similarity of all members of two clusters, which is the product of their summed vectors."""
    x = pairs.select("u", "v")
    a, b = sums.select(F.col("cluster").alias("u"), "gram", F.col("w").alias("wu"), F.col("n").alias("nu")), sums.select(F.col("cluster").alias("v"), "gram", F.col("w").alias("wv"), F.col("n").alias("nv"))
    return x.join(a, "u").join(b, ["v", "gram"]).groupBy("u", "v").agg(F.sum(F.col("wu") * F.col("wv")).alias("s"), F.min("nu").alias("nu"), F.min("nv").alias("nv"))


def average_linkage(edges: DataFrame, threshold: float, vectors: DataFrame | None = None) -> DataFrame:
    """(node, cluster) of nodes with edges (u, v, sim), u < v.

    Without ``vectors`` a node weighs 1 and pairs without an edge have similarity 0. ``vectors`` holds
    (node, gram, w, n), the summed vector of a node's n members: then the average runs over all members of
    two clusters, edge or not, and edges only say which clusters are compared at all.

    Each round merges every pair of clusters that are each other's closest; average linkage is
    reducible, so this gives the clusters of one-merge-at-a-time agglomeration down to ``threshold``.
    The closest pair of all merges in any round, so the rounds end, and they go on until no pair is left.
    Clusters are named by their least node.
    """
    pairs = edges.select("u", "v", F.col("sim").alias("s"), F.lit(1).cast("bigint").alias("nu"), F.lit(1).cast("bigint").alias("nv"))
    sums, sums_path = _kept(vectors.select(F.col("node").alias("cluster"), "gram", "w", "n"), "sums", None) if vectors is not None else (None, None)
    cur, path = _kept(pairs if sums is None else _totals(pairs, sums), "links", None)
    nodes = cur.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    names, names_path = _kept(nodes.select("node", F.col("node").alias("cluster")), "names", None)
    while True:
        near = cur.withColumn("avg", F.col("s") / (F.col("nu") * F.col("nv"))).where(F.col("avg") >= threshold)
        rank = F.struct(F.col("avg"), (-F.xxhash64("u", "v")).alias("t"), F.col("u"), F.col("v"))
        ends = near.select(rank.alias("r"), F.explode(F.array("u", "v")).alias("n"))
        best = ends.groupBy("n").agg(F.max("r").alias("r"))
        merges = best.groupBy("r.u", "r.v").agg(F.count("*").alias("c")).where("c = 2").select(F.col("v").alias("old"), F.col("u").alias("new"))
        merges, merges_path = _kept(merges, "merges", None)
        if merges.limit(1).count() == 0:
            for done in filter(None, (merges_path, path, sums_path)):
                drop_path(cur.sparkSession, done)
            break
        names, names_path = _kept(names.join(merges, names["cluster"] == merges["old"], "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "names", names_path)
        moved = merges.unionByName(merges.select(F.col("new").alias("old"), "new"))
        x = cur.withColumn("again", F.lit(False))
        for end in "uv":
            m = moved.select(F.col("old").alias(end), F.col("new").alias("__new"))
            x = x.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).withColumn("again", F.col("again") | F.col("__new").isNotNull()).drop("__new")
        x = x.where("u <> v").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v"), "nu": F.when(F.col("u") < F.col("v"), F.col("nu")).otherwise(F.col("nv")), "nv": F.when(F.col("u") < F.col("v"), F.col("nv")).otherwise(F.col("nu"))})
        if sums is None:
            size = names.groupBy("cluster").agg(F.count("*").alias("n"))
            x = x.groupBy("u", "v").agg(F.sum("s").alias("s"))
            for end in "uv":
                x = x.join(size.select(F.col("cluster").alias(end), F.col("n").alias(f"n{end}")), end)
        else:
            s = sums.join(moved, sums["cluster"] == moved["old"], "left").withColumn("cluster", F.coalesce("new", "cluster"))
            size = sums.select("cluster", "n").distinct().join(merges, F.col("cluster") == F.col("old"), "left").groupBy(F.coalesce("new", "cluster").alias("cluster")).agg(F.sum("n").alias("n"))
            sums, sums_path = _kept(s.groupBy("cluster", "gram").agg(F.sum("w").alias("w")).join(size, "cluster"), "sums", sums_path)
            x = x.where("not again").select("u", "v", "s", "nu", "nv").unionByName(_totals(x.where("again").select("u", "v").distinct(), sums))
        cur, path = _kept(x.select("u", "v", "s", "nu", "nv"), "links", path)
        drop_path(cur.sparkSession, merges_path)
    return names
