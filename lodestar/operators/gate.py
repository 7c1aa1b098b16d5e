"""Relevance gate: a configuration of patterns compiled to one Column, evaluated inside the scan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def include_groups(patterns: Sequence) -> list[list[str]]:
    """AND of OR groups: a flat list is one group, a list of lists several; empty groups are skipped, mixtures refused."""
    nested = [isinstance(p, (list, tuple)) for p in patterns]
    if any(nested) and not all(nested):
        raise ValueError("patterns mix groups and single entries")
    groups = [list(p) for p in patterns] if any(nested) else [list(patterns)]
    return [g for g in groups if g]


def java_pattern(patterns: Sequence[str]) -> str:
    """One case-insensitive alternation; the configuration's ``\\y`` word boundary becomes ``\\b``."""
    return "(?i)" + "|".join(p.replace(r"\y", r"\b") for p in patterns)


def matches(column: Column, patterns: Sequence[str]) -> Column:
    """Null on a null column, as the gate's three-valued logic needs."""
    return column.rlike(java_pattern(patterns))


def location_ok(columns: Sequence[str], known: Sequence[str]) -> Column:
    """OR of flags with null as false; no columns is always true; names are checked against the table."""
    for c in columns:
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", c) or c not in known:
            raise ValueError(f"unknown location column {c!r}")
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in columns]) if columns else F.lit(True)


def tier(cfg: Mapping, known: Sequence[str], title: str = "title", description: str = "description_text", company: str = "company_name", platform: str = "platform") -> Column:
    """1 where row and location pass, 2 where only the row does, else 3; nulls fall through to the next arm."""
    text = F.coalesce(F.col(description), F.lit(""))
    include = None
    for column, key in ((F.col(title), "title_include"), (text, "description_include")):
        groups = include_groups(cfg.get(key, []))
        if groups:
            part = reduce(lambda a, b: a & b, [matches(column, g) for g in groups])
            include = part if include is None else include | part
    row = F.lit(True) if include is None else include
    if include is not None and cfg.get("title_exclude"):
        row = row & ~matches(F.col(title), cfg["title_exclude"])
    for column, key in ((F.col(company), "company_exclude"), (F.col(platform), "platform_exclude"), (text, "description_exclude")):
        if cfg.get(key):
            row = row & ~matches(column, cfg[key])
    return F.when(row & location_ok(cfg.get("location_columns", []), known), 1).when(row, 2).otherwise(3)


def union_gate(cfgs: Sequence[Mapping], known: Sequence[str], **columns: str) -> Column:
    """Whether any configuration lets the row through at its own ``max_tier``; false without configurations."""
    return reduce(lambda a, b: a | b, [tier(c, known, **columns) <= c.get("max_tier", 2) for c in cfgs], F.lit(False))


def loosened(cfg: Mapping) -> dict:
    """The gate with any title accepted and the exclusions kept."""
    return {**cfg, "title_include": ["."]}


def dead_patterns(rows: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """(pattern, hits) of every pattern in one pass; a pattern with no hits is dead."""
    counts = rows.agg(*[F.count_if(matches(F.col(column), [p])).alias(f"c{i}") for i, p in enumerate(patterns)])
    pairs = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("hits")) for i, p in enumerate(patterns)])
    return counts.select(F.explode(pairs).alias("x")).select("x.pattern", "x.hits")
