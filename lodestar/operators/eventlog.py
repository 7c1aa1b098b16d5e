"""Engagement log: rolling dedupe, derived skips, state fold, leases. Per-key work is bounded by the key's own log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolling_kept(rows: DataFrame, keys: Sequence[str], seconds: Column, window: int) -> DataFrame:
    """(keys, kept): instants kept when one is dropped if a kept one is at most ``window`` before it.

    A dropped instant does not extend the window, so a lag would be wrong; the fold runs over the sorted instants of one key.
    """
    a = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(seconds)).alias("a"))
    fold = F.expr(f"aggregate(a, cast(array() as array<bigint>), (k, x) -> case when size(k) = 0 or element_at(k, -1) < x - {window} then array_append(k, x) else k end)")
    return a.select(*keys, F.explode(fold).alias("kept"))


def derived_skips(log: DataFrame, render: Sequence[str], item: str, rank: str, event: str) -> DataFrame:
    """Impressions above the lowest opened rank of their render on items without any other event there."""
    opened = log.where(F.col(event) == "open").groupBy(*render).agg(F.max(rank).alias("__open"))
    other = log.where(F.col(event) != "impression").select(*render, item).distinct()
    seen = log.where(F.col(event) == "impression").join(opened, list(render)).where(F.col(rank) < F.col("__open"))
    return seen.join(other, [*render, item], "left_anti").drop("__open")


def state_fold(log: DataFrame, keys: Sequence[str], event: str, at: str, tie: str) -> DataFrame:
    """(keys, saved_at, dismissed_at): the last save or dismiss that no later undo cleared."""
    kinds = {"save": ("saved_at", "save", "unsave"), "dismiss": ("dismissed_at", "dismiss", "undismiss")}
    aggs = []
    for name, on, off in kinds.values():
        last = F.max(F.when(F.col(event).isin(on, off), F.struct(F.col(at), F.col(tie), (F.col(event) == on).alias("on"))))
        aggs.append(F.when(last.getField("on"), last.getField(at)).alias(name))
    return log.groupBy(*keys).agg(*aggs)


def leases(requests: DataFrame, key: str, seconds: str, holder: str, ttl: int) -> DataFrame:
    """(key, granted): requests that got the lease, in time order; a lease is free again ``ttl`` after its grant."""
    a = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seconds).alias("t"), F.col(holder).alias("h")))).alias("a"))
    fold = F.expr(f"aggregate(a, cast(array() as array<struct<t:bigint,h:bigint>>), (k, x) -> case when size(k) = 0 or element_at(k, -1).t <= x.t - {ttl} then array_append(k, x) else k end)")
    return a.select(key, F.explode(fold).alias("g")).select(key, F.col("g.t").alias("granted"), F.col("g.h").alias("holder"))


def visibility(event: Column) -> Column:
    """Who may see an event: saves count for the cohort, without names."""
    return F.when(event == "save", "cohort_anon").otherwise("private")
