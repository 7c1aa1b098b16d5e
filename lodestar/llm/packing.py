"""Filling fixed-capacity containers: best-fit decreasing over a segment tree of remaining capacities.

Items are hashed into groups of bounded size and each group is packed by itself: longest item first, into
the open bin it fills tightest, found in logarithmic time; no item is split unless it exceeds the capacity, and then
into full containers and one remainder. Bins that stay slacker than ``SLACK`` are opened again and their
items packed together across groups, until they fit in one group or a pass gains nothing.

Defined results: null and empty texts have no tokens and go into no container; an item of exactly the
capacity fills one container; equal sizes go in order of their id; a capacity below 1 gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import bounded_rows, materialize

#: Items of one group (bounds a task's memory); share of a bin left empty above which it is packed again; most passes.
GROUP_ITEMS, SLACK, PASSES = 50_000, 0.02, 3
#: Largest number of capacities in one call.
MAX_PACKS = 1_000


class BestFit:
    """Open bins by remaining capacity in a segment tree that counts them; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}
        self.opened = 0

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, size: int) -> int:
        """Least remaining capacity >= ``size`` of an open bin, or -1."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the right sibling has an open bin: its leftmost one
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def place(self, size: int) -> int:
        """Bin for an item of ``size``; opens one if none fits."""
        room = self.tightest(size)
        if room < 0:
            b, room = self.opened, self.capacity
            self.opened += 1
        else:
            b = self.bins[room].pop()
            self._change(room, -1)
        if room > size:
            self.bins.setdefault(room - size, []).append(b)
            self._change(room - size, 1)
        return b


def pack_sizes(sizes: np.ndarray, ids: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, room left in that bin), longest items first, equal ones by id."""
    order = np.lexsort((ids, -sizes))
    fit, out = BestFit(capacity), np.empty(len(sizes), dtype=np.int64)
    for i in order:
        out[i] = fit.place(int(sizes[i]))
    used = np.bincount(out, weights=sizes, minlength=max(fit.opened, 1)).astype(np.int64)
    return out, (capacity - used)[out]


_SCHEMA = "pack_name string, capacity int, item_id bigint, piece int, size bigint, group bigint, bin bigint, room bigint"


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item_id", "piece"], kind="stable").reset_index(drop=True)
    pdf["bin"], pdf["room"] = pack_sizes(pdf["size"].to_numpy(), np.arange(len(pdf)), int(pdf["capacity"].iloc[0]))
    return pdf[["pack_name", "capacity", "item_id", "piece", "size", "group", "bin", "room"]]


def pack(sizes: DataFrame, packs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(pack_name, container, key, piece, first_token, last_token, n_tokens): containers of each capacity; ``last_token`` is exclusive."""
    limits = [(r["pack_name"], int(r["capacity_tokens"])) for r in bounded_rows(packs.select("pack_name", "capacity_tokens").where("pack_name is not null and capacity_tokens >= 1"), MAX_PACKS, "packs")]
    spark = sizes.sparkSession
    out_schema = f"pack_name string, container bigint, {key} bigint, piece int, first_token bigint, last_token bigint, n_tokens bigint"
    if not limits:
        return spark.createDataFrame([], out_schema)
    caps = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity")) for n, c in limits]))
    # written once: counting, full pieces and remainders all read it, and sizes may be costly to work out
    once = materialize(sizes.select(F.col(key).cast("bigint").alias("item_id"), F.col(size).cast("bigint").alias("total")).where("item_id is not null and total > 0"), "sizes")
    items = once.select("*", caps.alias("p")).select("p.pack_name", "p.capacity", "item_id", "total")
    whole = F.floor(F.col("total") / F.col("capacity")).cast("int")
    n = once.count()
    full = items.where(whole > 0).select("pack_name", "capacity", "item_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select("pack_name", "capacity", "item_id", "piece", F.col("capacity").cast("bigint").alias("size"), F.lit(-1).cast("bigint").alias("group"), F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("room"))
    rest = items.select("pack_name", "capacity", "item_id", whole.alias("piece"), (F.col("total") % F.col("capacity")).alias("size")).where("size > 0")
    done, groups, at = [full], max(1, -(-n // GROUP_ITEMS)), 0
    while True:
        grouped = rest.withColumn("group", F.pmod(F.xxhash64("item_id", "piece", F.lit(at)), F.lit(groups)).cast("bigint"))
        packed = materialize(grouped.groupBy("pack_name", "group").applyInPandas(_pack_group, _SCHEMA).withColumn("group", F.col("group") + F.lit(at << 32)), "packed")
        slack = F.col("room") > F.col("capacity") * SLACK
        loose = packed.where(slack)
        at += 1
        if groups == 1 or at >= PASSES:
            done.append(packed)
            break
        done.append(packed.where(~slack))
        rest, before = loose.select("pack_name", "capacity", "item_id", "piece", "size"), groups
        groups = max(1, -(-loose.count() // (GROUP_ITEMS * len(limits))))
        if groups >= before:
            done[-1] = packed
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    container = F.when(F.col("group") < 0, F.xxhash64("pack_name", "item_id", "piece")).otherwise(F.xxhash64("pack_name", "group", "bin", F.lit("bin")))
    first = F.col("piece").cast("bigint") * F.col("capacity")
    return out.select("pack_name", container.alias("container"), F.col("item_id").alias(key), "piece", first.alias("first_token"), (first + F.col("size")).alias("last_token"), F.col("size").alias("n_tokens"))


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, pieces, tokens, least_containers, fill): how full the containers are."""
    used = packed.groupBy("pack_name").agg(F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    r = packs.select("pack_name", "capacity_tokens").join(used, "pack_name")
    return r.select("pack_name", "capacity_tokens", "containers", "pieces", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint").alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
