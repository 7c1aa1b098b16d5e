"""Sinks: run history, fixtures, page responses, run summaries, snapshot replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import scratch


def sorted_json(df: DataFrame) -> Column:
    """One JSON object per row with its keys in order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, keys in order."""
    df.select(sorted_json(df).alias("value")).write.mode("overwrite").text(path)


def append_history(spark: SparkSession, path: str | None, rows: DataFrame, order: str, keep: int) -> str:
    """A new history with ``rows`` added and only the newest ``keep`` kept; returns its path, the old one is untouched."""
    old = spark.read.schema(rows.schema).json(path) if path else rows.limit(0)
    target = scratch(spark, "history")
    old.unionByName(rows).orderBy(F.desc(order)).limit(keep).write.json(target)
    return target


def page_response(items: DataFrame, limit: int, cursor: list[str]) -> DataFrame:
    """(body): one JSON page of ordered ``items`` holding up to limit + 1 rows; the cursor of the last shown row if more follow."""
    shown = F.slice("x", 1, limit)
    last = F.element_at(shown, -1)
    nxt = F.when(F.size("x") > limit, F.base64(F.to_json(F.struct(*[last[c].alias(c) for c in cursor])).cast("binary")))
    x = items.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in items.columns if c != "rank"]))).alias("x"))
    return x.select(F.to_json(F.struct(shown.alias("jobs"), nxt.alias("next_cursor"))).alias("body"))


def summary_line(table: str, new: Column, updated: Column, unchanged: Column, errors: Column) -> Column:
    """A run's result as one line that :func:`parse_summary` reads."""
    return F.format_string(f"upsert {table}: new=%d updated=%d unchanged=%d errors=%d", new, updated, unchanged, errors)


def parse_summary(text: Column) -> Column:
    """Map of counts of a summary line; null without one, not zeros."""
    pairs = F.regexp_extract_all(text, F.lit(r"(new|updated|unchanged|errors)=(\d+)"), F.lit(1))
    counts = F.regexp_extract_all(text, F.lit(r"(new|updated|unchanged|errors)=(\d+)"), F.lit(2))
    return F.when(F.size(pairs) > 0, F.map_from_arrays(pairs, F.transform(counts, lambda x: x.cast("bigint"))))


def fixed_width(cells: list[tuple[Column, int]]) -> Column:
    """One line of a text report."""
    return F.concat_ws(" ", *[F.rpad(F.coalesce(c.cast("string"), F.lit("-")), n, " ") for c, n in cells])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
