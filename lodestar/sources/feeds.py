"""Feed and page readers: saved pages and crawls over them, RSS, sitemaps, listings, JSON-LD, comment threads, JSON lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import scalar as S


def read_pages(spark: SparkSession, folder: str, rows: str = "rows") -> DataFrame:
    """(position, total, row) of saved pages ``{"offset", "total", rows: [...]}`` below a folder, one file a page, on any file system."""
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    page = docs.select(F.get_json_object("value", "$.offset").cast("bigint").alias("offset"), F.get_json_object("value", "$.total").cast("bigint").alias("total"), F.from_json(F.get_json_object("value", f"$.{rows}"), "array<string>").alias("x"))
    return page.select("offset", F.coalesce("total", F.lit(-1)).alias("total"), F.posexplode("x").alias("i", "row")).select((F.coalesce("offset", F.lit(0)) + F.col("i")).alias("position"), "total", "row")


def crawl(pages: DataFrame, board: str, page_size: int, max_pages: int) -> DataFrame:
    """The pages a crawl takes of (board, page, rows): from the first on, until a page is missing or not full, at most ``max_pages``.

    With ``last``: whether the crawl ended on a page that was not full, so that nothing was left behind.
    """
    n = F.size("rows")
    w = Window.partitionBy(board).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    whole = (F.coalesce(F.sum((n >= page_size).cast("int")).over(w), F.lit(0)) == F.col("page")) & (F.col("page") < max_pages)
    return pages.withColumn("__on", whole).where("__on").drop("__on").withColumn("last", n < page_size)


def crawl_report(pages: DataFrame, key: str, page_size: int, max_rows: int) -> DataFrame:
    """(collected, distinct_rows, total, truncated, short): whether a crawl hit its cap or misses a page or more of what was reported."""
    k = F.get_json_object("row", f"$.{key}")
    r = pages.agg(F.count("*").alias("collected"), F.countDistinct(k).alias("distinct_rows"), F.max("total").alias("total"))
    return r.select("*", (F.col("collected") >= max_rows).alias("truncated"), ((F.col("total") > 0) & (F.col("total") - F.col("distinct_rows") >= page_size)).alias("short"))


def shortfalls(rows: DataFrame, board: str, key: str, total: str, page_size: int) -> DataFrame:
    """(board, collected, total, short) of rows crawled from several boards, each row once by ``key``; :func:`complete_or_raise` refuses short ones."""
    r = rows.groupBy(board).agg(F.countDistinct(key).alias("collected"), F.max(total).alias("total"))
    return r.withColumn("short", F.col("total") - F.col("collected") >= page_size)


def first_of_code(rows: DataFrame, board: str, code: str, order: str, counts: DataFrame) -> DataFrame:
    """Rows of a source asked in two calls: of equal codes on a board the first one in ``order``, with the number the count call gave (null without one)."""
    first = rows.where(F.col(code).isNotNull()).groupBy(board, code).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (board, code)]), order).alias("x"))
    return first.select(board, code, "x.*").join(counts.groupBy(board).agg(F.max("reported").alias("reported")), board, "left")


def facet_slices(facets: DataFrame, totals: DataFrame, board: str, cap: int) -> DataFrame:
    """(board, facet, slices): of (board, facet, value, n) the facet with fewest slices that each stay under the cap and together reach the board's total."""
    f = facets.groupBy(board, "facet").agg(F.count("*").alias("slices"), F.max("n").alias("most"), F.sum("n").alias("all"))
    fits = f.join(totals, board).where((F.col("most") < cap) & (F.col("all") >= F.col("total")))
    return fits.groupBy(board).agg(F.min(F.struct("slices", "facet")).alias("x")).select(board, "x.facet", "x.slices")


def reconciled(collected: Column, before: Column, after: Column) -> Column:
    """Whether a crawl's count lies between the counts before and after it, within 2 % or 5 rows."""
    low, high = F.least(before, after), F.greatest(before, after)
    slack = F.greatest(F.lit(5), F.floor(high * 2 / 100))
    return collected.between(low - slack, high + slack)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files with a declared schema."""
    return spark.read.format("xml").option("rowTag", "item").schema("guid string, title string, pubDate string, region string, category string, link string, description string").load(path)


def sitemap_urls(texts: DataFrame, column: str) -> DataFrame:
    """(kind, url): locations of sitemap texts; kind is ``urlset`` or ``index``."""
    kind = F.when(F.col(column).contains("<sitemapindex"), "index").otherwise("urlset")
    return texts.select(kind.alias("kind"), F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def listing_cards(pages: DataFrame, column: str, key: str) -> DataFrame:
    """(key, company, title, orphans): job cards of listing pages. A title needs a company anchor before it within its card; others are dropped and counted."""
    card = re.compile(r'data-id="company"[^>]*>([^<]*)<|data-id="title"[^>]*>([^<]*)<|(data-id="card")')
    inner = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["k"], b["t"]):
                company, orphans, found = None, 0, []
                for m in card.finditer(text or ""):
                    if m.group(3):
                        company = None
                    elif m.group(1) is not None:
                        company = m.group(1).strip()
                    elif company:
                        found.append((company, m.group(2).strip()))
                        company = None
                    else:
                        orphans += 1
                out += [(k, c, t, orphans) for c, t in found]
            yield pd.DataFrame(out, columns=[key, "company", "title", "orphans"])

    return pages.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(run, f"{key} {inner}, company string, title string, orphans bigint")


def json_ld_postings(pages: DataFrame, column: str, key: str, depth: int = 12) -> DataFrame:
    """(key, title, description): JobPosting objects of a page's JSON-LD blocks, found through graphs and lists; bad blocks are skipped."""
    block = re.compile(r'<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', re.S | re.I)
    inner = pages.schema[key].dataType.simpleString()

    def walk(node, level: int) -> Iterator[dict]:
        if level > depth:
            return
        if isinstance(node, list):
            for x in node:
                yield from walk(x, level + 1)
        elif isinstance(node, dict):
            kinds = node.get("@type", [])
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if any(str(k).lower() == "jobposting" for k in kinds):
                yield node
            for v in node.values():
                if isinstance(v, (list, dict)):
                    yield from walk(v, level + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b["k"], b["t"]):
                for m in block.finditer(text or ""):
                    try:
                        out += [(k, p.get("title"), p.get("description")) for p in walk(json.loads(m.group(1)), 0)]
                    except ValueError:
                        continue
            yield pd.DataFrame(out, columns=[key, "title", "description"])

    return pages.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(run, f"{key} {inner}, title string, description string")


def comment_header(c):
    """(company, title) of a comment's pipe-separated first line: the company comes first, the title is the segment that looks most like a role.

    Where every segment looks like a place, pay, terms or an address (a score below 0), there is no title.
    """
    parts = F.transform(F.split(F.split(c, "<p>|\n").getItem(0), r"\s*\|\s*"), lambda x: F.trim(x))
    rest = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda x: x != "")
    scored = F.array_max(F.transform(rest, lambda x, i: F.struct(S.segment_score(x).alias("s"), (-i).alias("i"), x.alias("x"))))
    return F.element_at(parts, 1), F.when(scored["s"] >= 0, scored["x"])


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; a bad line fails the read, or is skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def cached_response(key_parts: DataFrame, cache: DataFrame, now, ttl_hours: int = 24) -> DataFrame:
    """Requests with the cached body of the same digest that is younger than the lifetime; null where a fetch is due."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(key_parts.columns)])), 256)
    fresh = cache.where(F.col("stored_at") > now - F.expr(f"interval {ttl_hours} hours")).groupBy("digest").agg(F.max_by("body", "stored_at").alias("body"))
    return key_parts.withColumn("digest", digest).join(fresh, "digest", "left")


def read_board(spark: SparkSession, path: str, rows: str = "jobs") -> DataFrame:
    """(row) of single-shot board files: one JSON document per file with a list of postings under ``rows``."""
    docs = spark.read.option("wholetext", True).text(path)
    return docs.select(F.explode(F.from_json(F.get_json_object("value", f"$.{rows}"), "array<string>")).alias("row"))


def complete_or_raise(report: DataFrame) -> DataFrame:
    """A crawl's report, refused if a page or more of what was announced is missing."""
    if report.where("short").limit(1).count():
        raise ValueError("the crawl misses at least one page of the reported total")
    return report


def with_retries(fetch, max_retries: int = 3, wait=None, transient: tuple[type[Exception], ...] = (OSError,)):
    """The result of ``fetch()``; transient failures are tried again after 1, 2, 4 ... units, then raised."""
    for attempt in range(max_retries + 1):
        try:
            return fetch()
        except transient:
            if attempt == max_retries:
                raise
            if wait:
                wait(2**attempt)
    return None


def dispatch_plan(requests: DataFrame, cache: DataFrame, now, quota_left: int, order: str) -> DataFrame:
    """Requests with what to do about each: ``cached``, ``fetch`` while quota lasts (in ``order``), else ``refused``."""
    x = cached_response(requests, cache, now)
    n = F.sum(F.col("body").isNull().cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("plan", F.when(F.col("body").isNotNull(), "cached").when(n <= quota_left, "fetch").otherwise("refused"))


def quota_ledger(spends: DataFrame, vendor: DataFrame, account: str = "account") -> DataFrame:
    """(account, spent, billed, drift): our own count of calls beside the vendor's counter, which is the referee."""
    s = spends.groupBy(account).agg(F.sum("calls").alias("spent"))
    v = vendor.groupBy(account).agg((F.max("counter") - F.min("counter")).alias("billed"))
    return s.join(v, account, "full_outer").select(account, F.coalesce("spent", F.lit(0)).alias("spent"), F.coalesce("billed", F.lit(0)).alias("billed")).withColumn("drift", F.col("billed") - F.col("spent"))


def paced(instants: DataFrame, key: str, seconds: str, per_minute: int, per_day: int) -> DataFrame:
    """(key, seconds, allowed): calls that keep to a number per minute and per day, by their place in each."""
    minute = Window.partitionBy(key, F.floor(F.col(seconds) / 60)).orderBy(seconds)
    day = Window.partitionBy(key, F.floor(F.col(seconds) / 86400)).orderBy(seconds)
    x = instants.withColumn("__m", F.row_number().over(minute) <= per_minute)
    return x.withColumn("__d", F.sum(F.col("__m").cast("int")).over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= per_day).select(key, seconds, (F.col("__m") & F.col("__d")).alias("allowed"))


def without_comments(config):
    """A configuration without the keys that begin with an underscore, at any depth."""
    if isinstance(config, dict):
        return {k: without_comments(v) for k, v in config.items() if not k.startswith("_")}
    return [without_comments(x) for x in config] if isinstance(config, list) else config
