"""Queries of sources, sinks and streams. Payloads are written from the tables and read back by the source's own reader."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.plans.common import LOG, POSTINGS, SCORED, facts, log, postings
from lodestar.plans.lifecycle import _KEPT, _RENDER, ranked_log
from lodestar.plans.windows_stats import scored
from lodestar.session import bounded_rows, scratch, write_text
from lodestar.sinks import writers
from lodestar.sources import feeds, records
from lodestar.streaming import engagement

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {POSTINGS} SELECT id, platform, title FROM postings WHERE platform = 'ashby'")
def s1_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("platform = 'ashby'").select("id", "platform", "title").dropDuplicates(["id"])


@query("SELECT count(*) AS collected, count(DISTINCT ref_id) AS distinct_rows, count(*) AS total, count(*) >= 250 AS truncated, false AS short FROM canonical_values")
def s4_offset_paging(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "pages")
    c = table(spark, d, "canonical_values").select("ref_id", "ref_value", F.floor(F.row_number().over(Window.orderBy("ref_id")) / 25.0001).alias("page"), F.count("*").over(Window.partitionBy()).alias("total"))
    page = c.groupBy("page", "total").agg(F.sort_array(F.collect_list(F.struct("ref_id", "ref_value"))).alias("rows")).select("page", F.to_json(F.struct((F.col("page") * 25).alias("offset"), "total", "rows")).alias("value"))
    for p in bounded_rows(page, 100, "pages of a fixed table"):
        write_text(spark, f"{path}/page-{p['page']:05d}.json", p["value"])
    return feeds.crawl_report(feeds.read_pages(spark, path), "ref_id", 25, 250)


def _pages(spark: SparkSession, d: str, page_size: int) -> DataFrame:
    """(board, page, rows, total) of the postings of each platform in order of their id."""
    w = Window.partitionBy("platform").orderBy("id")
    p = postings(spark, d, "platform").select(F.col("platform").alias("board"), "id", (F.row_number().over(w) - 1).alias("n"))
    total = p.groupBy("board").agg(F.count("*").alias("total"))
    return p.groupBy("board", F.floor(F.col("n") / page_size).cast("int").alias("page")).agg(F.sort_array(F.collect_list("id")).alias("rows")).join(total, "board")


@query(f"WITH {POSTINGS}, n AS (SELECT platform AS board, count(*) AS n FROM postings GROUP BY 1) SELECT board, least(n, 50) AS got, n >= 50 AS truncated FROM n")
def s3_page_cap(spark: SparkSession, d: str) -> DataFrame:
    """A board read in pages of 5, at most 10 of them; truncated where the last page taken was full."""
    taken = feeds.crawl(_pages(spark, d, 5), "board", 5, 10)
    return taken.groupBy("board").agg(F.sum(F.size("rows")).alias("got"), (F.sum(F.size("rows")) >= 50).alias("truncated"))


@query(f"WITH {POSTINGS}, n AS (SELECT platform AS board, count(*) AS n FROM postings GROUP BY 1) SELECT board, n AS collected, n // 40 + 1 AS pages, true AS complete FROM n WHERE n % 40 <> 0 AND n < 40 * 250")
def s8_stable_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A crawl in a stable order that ends on the page that is not full; boards cut by the page cap or ending on a full page are left out."""
    taken = feeds.crawl(_pages(spark, d, 40), "board", 40, 250)
    r = taken.groupBy("board").agg(F.sum(F.size("rows")).alias("collected"), F.count("*").alias("pages"), F.bool_or("last").alias("complete"))
    return r.where("complete")


@query(f"""WITH {POSTINGS}, x AS (SELECT platform AS board, id, (row_number() OVER (PARTITION BY platform ORDER BY id) - 1) // 10 AS page, count(*) OVER (PARTITION BY platform) AS total FROM postings),
g AS (SELECT board, total, count(*) FILTER (WHERE NOT (page = 1 AND length(board) % 2 = 1)) AS collected FROM x GROUP BY 1, 2) SELECT board, collected, total, total - collected >= 10 AS short FROM g""")
def s6_shortfall(spark: SparkSession, d: str) -> DataFrame:
    """Boards of which a page never came (the second of those with a name of odd length) are short; rows delivered twice count once."""
    rows = _pages(spark, d, 10).where("not (page = 1 and length(board) % 2 = 1)").select("board", "total", F.explode("rows").alias("id"))
    return feeds.shortfalls(rows.unionByName(rows), "board", "id", "total", 10)


@query("""WITH f AS (SELECT DISTINCT platform AS board, source_id AS code, arg_min(id, id) OVER (PARTITION BY platform, source_id) AS id FROM jobs WHERE source_id IS NOT NULL),
c AS (SELECT ats AS board, sum(open_jobs)::BIGINT AS reported FROM companies WHERE ats IS NOT NULL GROUP BY 1) SELECT f.board, f.code, f.id, c.reported FROM f LEFT JOIN c USING (board)""")
def s5_first_of_code(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "companies").where("ats is not null").groupBy(F.col("ats").alias("board")).agg(F.sum("open_jobs").alias("reported"))
    return feeds.first_of_code(table(spark, d, "jobs").select(F.col("platform").alias("board"), F.col("source_id").alias("code"), "id"), "board", "code", "id", counts)


@query("""WITH x AS (SELECT platform AS board, unnest(['department', 'location', 'level']) AS facet, unnest([department, location_raw, seniority_guess]) AS value FROM jobs),
n AS (SELECT board, facet, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT platform AS board, count(*) AS total FROM jobs GROUP BY 1),
g AS (SELECT board, facet, count(*) AS slices, max(n) AS most, sum(n) AS a FROM n GROUP BY 1, 2), ok AS (SELECT board, facet, slices FROM g JOIN t USING (board) WHERE most < 0.7 * 1000 AND a >= total)
SELECT board, arg_min(facet, (slices, facet)) AS facet, min(slices) AS slices FROM ok GROUP BY 1""")
def s7_facet_slices(spark: SparkSession, d: str) -> DataFrame:
    """The facet by which each board is best cut into slices under the cap of 700."""
    j = table(spark, d, "jobs").withColumnRenamed("platform", "board")
    x = j.select("board", F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("department", "department"), ("location", "location_raw"), ("level", "seniority_guess"))])).alias("x")).select("board", "x.*").where("value is not null")
    return feeds.facet_slices(x.groupBy("board", "facet", "value").agg(F.count("*").alias("n")), j.groupBy("board").agg(F.count("*").alias("total")), "board", 700)


@query("""WITH n AS (SELECT snapshot_no, platform, count(DISTINCT id) AS n FROM job_snapshots GROUP BY 1, 2), s AS (SELECT snapshot_no, platform, n AS before, lead(n) OVER w AS collected, lead(n, 2) OVER w AS after FROM n WINDOW w AS (PARTITION BY platform ORDER BY snapshot_no))
SELECT snapshot_no, platform, collected BETWEEN least(before, after) - greatest(5, floor(greatest(before, after) * 2 / 100)) AND greatest(before, after) + greatest(5, floor(greatest(before, after) * 2 / 100)) AS reconciled FROM s WHERE after IS NOT NULL""")
def s9_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A delivery's rows per platform against those of the deliveries before and after it."""
    n = table(spark, d, "job_snapshots").groupBy("snapshot_no", "platform").agg(F.countDistinct("id").alias("before"))
    w = Window.partitionBy("platform").orderBy("snapshot_no")
    x = n.select("*", F.lead("before").over(w).alias("collected"), F.lead("before", 2).over(w).alias("after")).where("after is not null")
    return x.select("snapshot_no", "platform", feeds.reconciled(F.col("collected"), F.col("before"), F.col("after")).alias("reconciled"))


@query("SELECT platform, CASE WHEN length(platform) % 6 <= 3 THEN 'page' END AS body, CASE WHEN length(platform) % 6 = 0 THEN 0 WHEN length(platform) % 6 = 1 THEN 1 WHEN length(platform) % 6 = 2 THEN 3 ELSE 7 END::BIGINT AS waited FROM platforms")
def s22_retries(spark: SparkSession, d: str) -> DataFrame:
    """A page per platform fetched with retries: the first attempts fail, a few more than are tried for some."""

    def run(batches):
        for b in batches:
            out = []
            for name in b["platform"]:
                left, waits = [len(name) % 6], []

                def fetch(left=left):
                    if left[0]:
                        left[0] -= 1
                        raise OSError("not yet")
                    return "page"

                try:
                    body = feeds.with_retries(fetch, 3, waits.append)
                except OSError:
                    body = None
                out.append((name, body, sum(waits)))
            yield pd.DataFrame(out, columns=["platform", "body", "waited"])

    return table(spark, d, "platforms").select("platform").mapInPandas(run, "platform string, body string, waited bigint")


@query("SELECT CAST(ref_id AS VARCHAR) AS guid, ref_field || ': ' || ref_value AS title FROM canonical_values")
def s10_rss(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "rss")
    esc = F.replace(F.concat_ws(": ", "ref_field", "ref_value"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><guid>"), F.col("ref_id").cast("string"), F.lit("</guid><title>"), esc, F.lit("</title></item>"))
    feed = F.concat(F.lit("<rss><channel>"), F.concat_ws("", F.collect_list(item)), F.lit("</channel></rss>"))
    table(spark, d, "canonical_values").agg(feed.alias("value")).write.text(path)
    return feeds.read_rss(spark, path).select("guid", "title")


@query(f"WITH {POSTINGS} SELECT id, trim(company_name) AS company, trim(title) AS title FROM postings")
def s11_listing_cards(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<div data-id="card"><a data-id="company">'), "company_name", F.lit('</a><h2 data-id="title">'), "title", F.lit("</h2></div>"))
    return feeds.listing_cards(postings(spark, d, "company_name", "title").select("id", html.alias("html")), "html", "id").select("id", "company", "title")


@query(f"WITH {POSTINGS} SELECT id, title FROM postings")
def s12_json_ld(spark: SparkSession, d: str) -> DataFrame:
    ld = F.to_json(F.struct(F.array(F.struct(F.lit("JobPosting").alias("@type"), F.col("title"), F.col("department").alias("description"))).alias("@graph")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script></html>"))
    return feeds.json_ld_postings(postings(spark, d, "title", "department").select("id", html.alias("html")), "html", "id").select("id", "title")


@query()
def s14_comment_header(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat_ws(" | ", "company_name", "location_raw", "title", F.lit("Full-time"))
    company, title = feeds.comment_header(F.col("c"))
    return postings(spark, d, "company_name", "location_raw", "title").select("id", head.alias("c")).select("id", company.alias("company"), title.alias("title"))


#: Header, company and title.
HEADERS = [
    ("Acme | Senior Engineer | Berlin | Full-time<p>body", "Acme", "Senior Engineer"), ("Acme | Full-time | REMOTE | https://acme.io", "Acme", None), ("Acme | $150k-250k | Data Analyst", "Acme", "Data Analyst"), ("Acme | Founding Lead | New York", "Acme", "Founding Lead"), ("Acme | Remote | Contract", "Acme", None), ("Acme", "Acme", None),
]


@query(" UNION ALL ".join(f"SELECT {i}::INT AS n, '{c}' AS company, {repr(t) if t else 'NULL'} AS title" for i, (_, c, t) in enumerate(HEADERS)))
def s14_cases(spark: SparkSession, d: str) -> DataFrame:
    company, title = feeds.comment_header(F.col("raw"))
    rows = table(spark, d, "region").limit(1).select(F.posexplode(F.array(*[F.lit(h) for h, _, _ in HEADERS])).alias("n", "raw"))
    return rows.select("n", company.alias("company"), title.alias("title"))


@query(f"WITH {POSTINGS} SELECT DISTINCT 'urlset' AS kind, job_url AS url FROM postings WHERE job_url IS NOT NULL")
def s15_sitemap(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit("<urlset><url><loc>"), "job_url", F.lit("</loc></url></urlset>"))
    return feeds.sitemap_urls(postings(spark, d, "job_url").where("job_url is not null").select(xml.alias("x")), "x").distinct()


@query("SELECT company_id, company_name FROM companies")
def s16_jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "companies").select("company_id", "company_name"), path)
    return feeds.read_jsonl(spark, path, "company_id bigint, company_name string")


@query("SELECT platform FROM platforms")
def s17_jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    p = table(spark, d, "platforms")
    lines = p.select(F.to_json(F.struct("platform")).alias("value"))
    lines.unionByName(p.select(F.lit("{broken").alias("value"))).write.text(path)
    return feeds.read_jsonl(spark, path, "platform string", strict=False)


@query("SELECT ref_id, ref_field = 'department' AS hit FROM canonical_values")
def s18_response_cache(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_values").select("ref_id", "ref_field")
    digest = F.sha2(F.to_json(F.struct("ref_field", "ref_id")), 256)
    age = F.when(F.col("ref_field") == "department", F.expr("timestamp'2026-01-02 00:00:00'")).otherwise(F.expr("timestamp'2025-12-31 00:00:00'"))
    cache = c.select(digest.alias("digest"), F.lit("body").alias("body"), age.alias("stored_at"))
    return feeds.cached_response(c, cache, F.expr("timestamp'2026-01-02 12:00:00'")).select("ref_id", F.col("body").isNotNull().alias("hit"))


@query("SELECT ref_id, generate_subscripts(string_split(alt_names, '|'), 1) - 1 AS position, unnest(string_split(alt_names, '|')) AS value FROM canonical_values WHERE alt_names IS NOT NULL")
def s20_array_relation(spark: SparkSession, d: str) -> DataFrame:
    """Arrays as a relation that keeps their order."""
    return table(spark, d, "canonical_values").select("ref_id", F.posexplode(F.split("alt_names", r"\|")).alias("position", "value")).select("ref_id", F.col("position").cast("bigint").alias("position"), "value")


@query("SELECT ref_id, '{\"field\": \"' || ref_field || '\", \"inner\": [{\"keep\": ' || ref_id || '}]}' AS config FROM canonical_values")
def f63_without_comments(spark: SparkSession, d: str) -> DataFrame:
    """Configurations without their comment keys."""
    strip = F.pandas_udf(lambda s: s.map(lambda t: json.dumps(feeds.without_comments(json.loads(t)))), "string")
    raw = F.to_json(F.struct(F.lit("why").alias("_note"), F.col("ref_field").alias("field"), F.array(F.struct(F.lit(1).alias("_x"), F.col("ref_id").alias("keep"))).alias("inner")))
    return table(spark, d, "canonical_values").select("ref_id", strip(raw).alias("config"))


@query("SELECT lower(ats) AS ats, lower(company_token) AS token, min(company_token) AS first_token FROM companies WHERE company_token IS NOT NULL AND status = 'active' GROUP BY 1, 2")
def s21_roster(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "companies").where("company_token is not null and status = 'active'")
    return c.groupBy(F.lower("ats").alias("ats"), F.lower("company_token").alias("token")).agg(F.min("company_token").alias("first_token"))


def _payload(spark: SparkSession, d: str, platform: str, body) -> DataFrame:
    p = postings(spark, d, "platform", "company_token", "company_name", "source_id", "title", "location_raw", "department", "job_url", "description_text").where(F.col("platform") == platform)
    return records.normalize(p.select("company_token", "company_name", F.to_json(body).alias("raw_json")), platform)


def _normalized_sql(platform: str, department: str = "department") -> str:
    return f"WITH {POSTINGS} SELECT source_id, title, location_raw, {department} AS department, job_url, regexp_matches(coalesce(location_raw, ''), '\\bremote\\b', 'i') AS remote FROM postings WHERE platform = '{platform}'"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source_id", "title", "location_raw", "department", "job_url", F.col("location_is_remote").alias("remote"))


@query(f"WITH {POSTINGS} SELECT CAST(hash % 1000000 AS VARCHAR) AS source_id, title, location_raw, department, job_url, regexp_matches(coalesce(location_raw, ''), '\\bremote\\b', 'i') AS remote FROM (SELECT *, length(title) * 1000 + length(job_url) AS hash FROM postings) WHERE platform = 'greenhouse'")
def n1_greenhouse(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct((F.length("title") * 1000 + F.length("job_url")).alias("id"), "title", F.struct(F.col("location_raw").alias("name")).alias("location"), F.array(F.struct(F.col("department").alias("name"))).alias("departments"), F.col("description_text").alias("content"), F.col("job_url").alias("absolute_url"))
    return _shown(_payload(spark, d, "greenhouse", body))


@query(_normalized_sql("lever"))
def n2_lever(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("id"), F.col("title").alias("text"), F.lit(1767225600000).alias("createdAt"), F.struct(F.col("location_raw").alias("location"), F.col("department").alias("team")).alias("categories"), F.col("job_url").alias("hostedUrl"))
    return _shown(_payload(spark, d, "lever", body))


@query(_normalized_sql("ashby"))
def n3_ashby(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("id"), "title", F.col("location_raw").alias("location"), "department", F.col("job_url").alias("jobUrl"))
    return _shown(_payload(spark, d, "ashby", body))


@query(f"WITH {POSTINGS} SELECT source_id, title, nullif(trim(location_raw), '') AS location_raw, department, job_url, true AS remote FROM postings WHERE platform = 'workable'")
def n4_workable(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("shortcode"), "title", F.col("location_raw").alias("city"), F.lit(True).alias("telecommuting"), "department", F.col("job_url").alias("url"))
    return _shown(_payload(spark, d, "workable", body))


@query(f"WITH {POSTINGS} SELECT title, 'EUR 10-20 per hour' AS salary_text, true AS remote FROM postings WHERE platform = 'recruitee'")
def n5_recruitee(spark: SparkSession, d: str) -> DataFrame:
    pay = F.struct(F.lit(10.0).alias("min"), F.lit(20.0).alias("max"), F.lit("EUR").alias("currency"), F.lit("hour").alias("period"))
    body = F.struct("title", F.lit(True).alias("remote"), pay.alias("salary"))
    return _payload(spark, d, "recruitee", body).select("title", "salary_text", F.col("location_is_remote").alias("remote"))


@query(f"WITH {POSTINGS} SELECT source_id, title, nullif(trim(location_raw), '') AS location_raw, department, job_url, regexp_matches(coalesce(location_raw, ''), '\\bremote\\b', 'i') AS remote FROM postings WHERE platform = 'smartrecruiters'")
def n6_smartrecruiters(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("id"), F.col("title").alias("name"), F.struct(F.col("location_raw").alias("city")).alias("location"), F.struct(F.col("department").alias("label")).alias("department"), F.col("job_url").alias("ref"))
    return _shown(_payload(spark, d, "smartrecruiters", body))


@query(f"WITH {POSTINGS} SELECT title, company_name, location_raw, department FROM postings WHERE platform = 'google_jobs' AND false UNION ALL SELECT title, company_name, location_raw, NULL FROM postings WHERE platform = 'google_jobs'")
def n7_google_jobs(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct("title", "company_name", F.col("location_raw").alias("location"), F.col("job_url").alias("share_link"))
    return _payload(spark, d, "google_jobs", body).select("title", "company_name", "location_raw", "department")


@query()
def n8_workday(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("externalPath"), "title", F.col("location_raw").alias("locationsText"))
    return _payload(spark, d, "workday", body).select("source_id", "location_is_nyc", "location_is_remote")


@query(f"WITH {POSTINGS} SELECT source_id, title, '$50,000 - $60,000 Annual' AS salary_text, true AS nyc FROM postings WHERE platform = 'nyc_open_data'")
def n9_nyc_open_data(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("job_id"), F.col("title").alias("business_title"), F.lit("50000").alias("salary_range_from"), F.lit("60000").alias("salary_range_to"), F.lit("Annual").alias("salary_frequency"))
    return _payload(spark, d, "nyc_open_data", body).select("source_id", "title", "salary_text", F.col("location_is_nyc").alias("nyc"))


@query(f"WITH {POSTINGS} SELECT source_id, substr(company_name || ': ' || title, position(': ' IN company_name || ': ' || title) + 2) AS title, split_part(company_name, ': ', 1) AS company_name, '2026-01-01T05:00:00' AS posted_at FROM postings WHERE platform = 'weworkremotely'")
def n10_weworkremotely(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("source_id").alias("guid"), F.concat_ws(": ", "company_name", "title").alias("title"), F.lit("Thu, 01 Jan 2026 00:00:00 -0500").alias("pubDate"))
    return _payload(spark, d, "weworkremotely", body).select("source_id", "title", "company_name", "posted_at")


@query(f"WITH {POSTINGS} SELECT title, company_name, 'senior' AS level, true AS remote FROM postings WHERE platform = 'builtin_nyc'")
def n11_builtin(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.col("company_name").alias("company"), "title", F.col("location_raw").alias("location"), F.lit("Senior level").alias("level"), F.lit("Remote").alias("remote"), F.col("job_url").alias("url"))
    return _payload(spark, d, "builtin_nyc", body).select("title", "company_name", F.col("seniority_guess").alias("level"), F.col("location_is_remote").alias("remote"))


@query(_normalized_sql("workday"))
def n13_fixture(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "platform", "company_token", "company_name", "source_id", "title", "location_raw", "department", "job_url").where("platform = 'workday'")
    body = F.struct(F.col("source_id").alias("id"), "title", F.col("location_raw").alias("location"), "department", F.col("job_url").alias("url"))
    return _shown(records.normalize(p.select("company_token", "company_name", F.to_json(body).alias("raw_json")), "fixture"))


@query(f"WITH {POSTINGS} SELECT source_id, title FROM postings WHERE platform = 'recruitee'")
def s2_single_shot_board(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "board")
    p = postings(spark, d, "platform", "company_token", "source_id", "title").where("platform = 'recruitee'")
    boards = p.groupBy("company_token").agg(F.to_json(F.struct(F.collect_list(F.struct("source_id", "title")).alias("jobs"))).alias("value"))
    boards.select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = feeds.read_board(spark, path)
    return rows.select(F.get_json_object("row", "$.source_id").alias("source_id"), F.get_json_object("row", "$.title").alias("title"))


@query("SELECT ref_id, CASE WHEN ref_field = 'department' THEN 'cached' WHEN count(*) FILTER (WHERE ref_field <> 'department') OVER (ORDER BY ref_id) <= 20 THEN 'fetch' ELSE 'refused' END AS plan FROM canonical_values")
def s19_dispatch(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_values").select("ref_id", "ref_field")
    cache = c.where("ref_field = 'department'").select(F.sha2(F.to_json(F.struct("ref_field", "ref_id")), 256).alias("digest"), F.lit("body").alias("body"), F.expr("timestamp'2026-01-02 00:00:00'").alias("stored_at"))
    return feeds.dispatch_plan(c, cache, F.expr("timestamp'2026-01-02 12:00:00'"), 20, "ref_id").select("ref_id", "plan")


@query(f"WITH {LOG}, s AS (SELECT user_id, epoch(ts)::BIGINT AS s, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts) AS rn FROM log) SELECT user_id, count(*) FILTER (WHERE rn <= 2) AS allowed, count(*) AS asked FROM s GROUP BY 1")
def t19_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return feeds.paced(e, "user_id", "s", 1_000, 2).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("asked"))


@query(f"WITH {LOG} SELECT job_id AS account, count(*) AS spent, max(event_id) - min(event_id) AS billed, max(event_id) - min(event_id) - count(*) AS drift FROM log GROUP BY 1")
def t20_quota_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).select(F.col("job_id").alias("account"), F.lit(1).alias("calls"), F.col("event_id").alias("counter"))
    return feeds.quota_ledger(e, e)


@query(f"WITH {POSTINGS} SELECT platform, count(*) AS n FROM postings WHERE platform IN ('lever', 'ashby') GROUP BY 1")
def x2_union_sources(spark: SparkSession, d: str) -> DataFrame:
    lever = _payload(spark, d, "lever", F.struct(F.col("source_id").alias("id"), F.col("title").alias("text")))
    ashby = _payload(spark, d, "ashby", F.struct(F.col("source_id").alias("id"), "title"))
    return records.union_sources([lever, ashby]).groupBy("platform").agg(F.count("*").alias("n"))


@query(f"WITH {LOG}, c AS (SELECT job_id, count(*) FILTER (WHERE ev = 'save') AS n, count(*) FILTER (WHERE ev = 'open') AS u FROM log GROUP BY 1) SELECT job_id, n AS new, u AS updated FROM c")
def k2_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    c = log(spark, d).groupBy("job_id").agg(F.count_if(F.col("ev") == "save").alias("n"), F.count_if(F.col("ev") == "open").alias("u"))
    line = writers.summary_line("jobs", F.col("n"), F.col("u"), F.lit(0), F.lit(0))
    return c.select("job_id", writers.parse_summary(line).alias("m")).select("job_id", F.element_at("m", F.lit("new")).alias("new"), F.element_at("m", F.lit("updated")).alias("updated"))


@query("SELECT batch_no AS run_no, count(*) AS written FROM posting_batches GROUP BY 1 ORDER BY run_no DESC LIMIT 4")
def k3_history_retention(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "posting_batches").groupBy(F.col("batch_no").alias("run_no")).agg(F.count("*").alias("written"))
    first = writers.append_history(spark, None, runs.where("run_no < 5"), "run_no", 4)
    return spark.read.schema(runs.schema).json(writers.append_history(spark, first, runs.where("run_no >= 5"), "run_no", 4))


@query("SELECT c_custkey, json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment)::VARCHAR AS line FROM customer")
def k4_sorted_json(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    return c.select("c_custkey", writers.sorted_json(c).alias("line"))


@query(f"WITH {SCORED} SELECT id, match_score FROM scored ORDER BY match_score DESC, id LIMIT 25")
def k5_page_response(spark: SparkSession, d: str) -> DataFrame:
    top = scored(spark, d).select("id", "match_score").orderBy(F.desc("match_score"), "id").limit(26)
    page = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("match_score"), "id")))
    body = writers.page_response(page, 25, ["match_score", "id"])
    rows = F.from_json("body", "jobs array<struct<id:string,match_score:int>>")["jobs"]
    return body.select(F.explode(rows).alias("r")).select("r.id", "r.match_score")


@query("SELECT rpad(n_name, 12, ' ') || ' ' || rpad(CAST(n_regionkey AS VARCHAR), 4, ' ') AS line FROM nation")
def k6_text_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(writers.fixed_width([(F.col("n_name"), 12), (F.col("n_regionkey"), 4)]).alias("line"))


@query(f"WITH {_KEPT}, g AS (SELECT user_id, job_id, list_reduce(list_prepend([]::BIGINT[], list_transform(a, lambda x: [x])), lambda k, x: CASE WHEN len(k) = 0 OR k[-1] < x[1] - 86400 THEN list_concat(k, x) ELSE k END) AS kept FROM seen) SELECT user_id, job_id, unnest(kept) AS kept FROM g")
def t2_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = engagement.arrivals(spark, log(spark, d).where("ev = 'impression'").select("user_id", "job_id", "ts"))
    return engagement.run_available(engagement.rolling_dedupe(s), "dedupe")


@query(f"WITH {LOG} SELECT date_trunc('hour', ts) AS start, ev AS event_type, count(*) AS n FROM log GROUP BY 1, 2")
def t22_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    s = engagement.arrivals(spark, log(spark, d).select("ts", F.col("ev").alias("event_type")))
    return engagement.run_available(engagement.windowed_counts(s), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {_RENDER}, o AS (SELECT user_id, day, max(rank) AS lowest FROM k WHERE ev = 'open' GROUP BY 1, 2) SELECT k.event_id FROM k JOIN o USING (user_id, day) WHERE k.ev = 'impression' AND k.rank < lowest AND NOT EXISTS (SELECT 1 FROM k x WHERE x.user_id = k.user_id AND x.day = k.day AND x.job_id = k.job_id AND x.ev <> 'impression')")
def t3_stream_skips(spark: SparkSession, d: str) -> DataFrame:
    s = engagement.arrivals(spark, ranked_log(spark, d).select("user_id", "day", "ts", "job_id", "rank", "ev", "event_id"))
    return engagement.run_available(engagement.render_skips(s, ["user_id", "day"], 86_400), "skips")


@query(f"WITH {POSTINGS} SELECT p.id, coalesce(f.n, 0) AS facts FROM postings p LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT DISTINCT * FROM jobs_app) GROUP BY 1) f USING (id)")
def k7_view(spark: SparkSession, d: str) -> DataFrame:
    n = facts(spark, d, "platform").groupBy("id").agg(F.count("*").alias("n"))
    postings(spark, d, "status").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("facts")).createOrReplaceTempView("lodestar_jobs_view")
    return spark.sql("SELECT id, facts FROM lodestar_jobs_view")
