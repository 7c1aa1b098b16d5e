"""Queries of the scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.functions import scalar as S
from lodestar.plans.common import FACTS, POSTINGS, facts, postings

QUERIES, ORACLE = {}, {}
NOW = "2026-11-20 12:00:00"


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


_NYC = "\\b(new york|nyc|manhattan|brooklyn|queens|bronx|staten island)\\b"
_SENIOR = "\\b(senior|sr\\.?|staff|principal|director|vp\\b|vice president|head of|lead\\b|chief|executive|manager)\\b"
_ENTRY = "\\b(entry.?level|junior|jr\\.?|new grad|graduate|intern(ship)?|apprentice|associate|coordinator)\\b"


@query(f"WITH {POSTINGS} SELECT id, substr(sha256(coalesce(platform, 'None') || ':' || coalesce(company_token, 'None') || ':' || coalesce(source_id, 'None')), 1, 24) AS made FROM postings")
def f1_stable_id(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "platform", "company_token", "source_id").select("id", S.stable_id(F.col("platform"), F.col("company_token"), F.col("source_id")).alias("made"))


@query(f"WITH {POSTINGS} SELECT id, sha256(coalesce(title, 'None') || '|' || CASE WHEN location_is_remote THEN 'True' WHEN NOT location_is_remote THEN 'False' ELSE 'None' END || '|' || coalesce(department, '')) AS hash FROM postings")
def f2_content_hash(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "title", "location_is_remote", "department")
    return p.select("id", S.content_hash([F.col("title"), S.python_bool(F.col("location_is_remote"))], [F.col("department")]).alias("hash"))


@query(f"WITH {POSTINGS} SELECT id, CASE WHEN platform IN ('lever','ashby') THEN sha256(coalesce(title,'None') || '|' || coalesce(location_raw,'None')) ELSE sha256(coalesce(title,'None') || '|' || coalesce(department,'None') || '|' || coalesce(status,'None')) END AS hash FROM postings")
def f3_hash_fields_by_source(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "platform", "title", "location_raw", "department", "status")
    a, b = S.content_hash([F.col("title"), F.col("location_raw")]), S.content_hash([F.col("title"), F.col("department"), F.col("status")])
    return p.select("id", F.when(F.col("platform").isin("lever", "ashby"), a).otherwise(b).alias("hash"))


@query()
def f4_normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "job_url").select("id", S.normalize_url("job_url").alias("url"))


@query()
def f5_search_source_id(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "company_token", "title", "job_url")
    return p.select("id", S.search_source_id(F.lit(None).cast("string"), "company_token", "title", S.normalize_url("job_url")).alias("source_id"))


@query()
def f6_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posting_batches").where("description_text is not null").select("posting_no", F.length(S.strip_html("description_text")).alias("chars"))


def _cases(spark: SparkSession, d: str, rows: list[str]) -> DataFrame:
    """(n, raw): literal texts as a one-row table's array."""
    return table(spark, d, "region").limit(1).select(F.posexplode(F.array(*[F.lit(x) for x in rows])).alias("n", "raw"))


def _wanted(rows: list[dict]) -> str:
    """SQL of the expected values by position."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT {i}::INT AS n, {', '.join(f'{text(v)} AS {c}' for c, v in row.items())}" for i, row in enumerate(rows))


STRIPPED = [
    ("<p>A &amp; B</p>", "A & B"), ("a &amp;nbsp; b", "a &nbsp; b"), ("x &amp;lt;b&amp;gt; y", "x &lt;b&gt; y"), ("&lt;div&gt;one&lt;/div&gt; two", "one two"), ("<br/>", None), ("", None), ("  plain \n text ", "plain text"),
    ('<div class="[&:has([data-x])>*]:p-0">kept</div>', "kept"), ('<a title="5 > 4">link</a>', "link"), ('<a title="open>text</a> more', "text more"), ("a <> b, 1 < 2", "a <> b, 1 < 2"), ("<i>caf&eacute;</i>", "café"),
]


@query(_wanted([{"text": w} for _, w in STRIPPED]))
def f6_markup_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d, [r for r, _ in STRIPPED]).select("n", S.strip_html("raw").alias("text"))


ESCAPED = [("&lt;h2&gt;About&amp;nbsp;us:&lt;/h2&gt; R&amp;amp;D", "About us: R&D"), ("plain &amp;amp; simple", "plain & simple")]


@query(_wanted([{"text": w} for _, w in ESCAPED]))
def f6_escaped_twice(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d, [r for r, _ in ESCAPED]).select("n", S.strip_html(S.unescape_html("raw")).alias("text"))


@query("SELECT company_id, coalesce(nullif(trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM companies")
def f7_slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("company_id", S.slugify(F.col("company_name")).alias("slug"))


@query(f"WITH {POSTINGS} SELECT id, CASE WHEN coalesce(title,'') = '' THEN 'unknown' WHEN regexp_matches(title, '{_SENIOR}', 'i') THEN 'senior' WHEN regexp_matches(title, '{_ENTRY}', 'i') THEN 'entry' ELSE 'mid_or_unspecified' END AS level FROM postings")
def f8_guess_seniority(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "title").select("id", S.guess_seniority(F.col("title")).alias("level"))


@query(f"WITH {POSTINGS} SELECT id, regexp_matches(coalesce(location_raw,''), '{_NYC}', 'i') AS nyc, regexp_matches(coalesce(location_raw,''), '\\bremote\\b', 'i') AS remote FROM postings")
def f9_classify_location(spark: SparkSession, d: str) -> DataFrame:
    nyc, remote = S.classify_location(F.col("location_raw"))
    return postings(spark, d, "location_raw").select("id", nyc.alias("nyc"), remote.alias("remote"))


@query(f"""WITH {POSTINGS}, {FACTS}, x AS (SELECT p.id, p.location_raw AS t, coalesce(regexp_matches(f.remote_policy, 'remote', 'i'), false) AS r FROM postings p LEFT JOIN facts f USING (id))
SELECT id, CASE WHEN coalesce(t,'') = '' OR regexp_matches(t, '^\\s*\\d+\\s+locations?\\s*$', 'i') THEN NULL WHEN NOT regexp_matches(t, '{_NYC}', 'i') AND NOT (regexp_matches(t, '\\bremote\\b', 'i') OR r) AND NOT regexp_matches(t, ',\\s*[A-Za-z]{{2,}}') THEN NULL ELSE regexp_matches(t, '{_NYC}', 'i') END AS nyc,
CASE WHEN coalesce(t,'') = '' OR regexp_matches(t, '^\\s*\\d+\\s+locations?\\s*$', 'i') THEN CASE WHEN r THEN true END ELSE regexp_matches(t, '\\bremote\\b', 'i') OR r END AS remote FROM x""")
def f10_location_flags(spark: SparkSession, d: str) -> DataFrame:
    nyc, remote = S.location_flags(F.col("location_raw"), F.col("remote_policy"))
    return postings(spark, d, "location_raw").join(facts(spark, d, "remote_policy"), "id", "left").select("id", nyc.alias("nyc"), remote.alias("remote"))


@query(f"WITH {POSTINGS} SELECT id, true AS valid, true AS fits, 'true' AS title_kept FROM postings WHERE title IS NOT NULL")
def f11_bounded_json(spark: SparkSession, d: str) -> DataFrame:
    """Every bounded payload reads as JSON again, keeps to its limit and, where only the long field was cut, its other fields."""
    p = postings(spark, d, "title", "description_text").where("title is not null").select("id", "title", F.to_json(F.struct("title", F.col("description_text").alias("description"))).alias("raw"))
    p = p.withColumn("bounded", S.bounded_json(600, "description")("raw"))
    return p.select("id", F.get_json_object("bounded", "$").isNotNull().alias("valid"), (F.length("bounded") <= 600).alias("fits"), (F.get_json_object("bounded", "$.title") == F.col("title")).cast("string").alias("title_kept"))


BOUNDED = [('{"a": 1}', '{"a": 1}'), ('{"a": 1, "d": "' + "x" * 80 + '"}', '{"a": 1, "d": "' + "x" * 43 + '"}'), ('{"a": "' + "y" * 80 + '"}', '{"_truncated": true, "_original_chars": 89}'), ("z" * 70, '{"_truncated": true, "_original_chars": 70}'), ('{"d": "' + '\\"' * 60 + '"}', '{"d": "' + '\\"' * 25 + '"}')]


@query(_wanted([{"bounded": w} for _, w in BOUNDED]))
def f11_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d, [r for r, _ in BOUNDED]).select("n", S.bounded_json(60, "d")("raw").alias("bounded"))


@query()
def f12_search_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("company_id", S.search_key("company_name").alias("key"))


@query(f"WITH {POSTINGS} SELECT id, CASE WHEN coalesce(trim(department), '') = '' THEN 'empty' WHEN length(department) > 20 THEN 'too_long' END AS error FROM postings")
def f13_validate_text(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "department").select("id", S.length_error(F.col("department"), 20).alias("error"))


_NORM = "regexp_replace(lower(trim({c})), '[- /]', '_', 'g')"


def _closed_sql(column: str, allowed: tuple[str, ...]) -> str:
    v = _NORM.format(c=column)
    arms = " ".join(f"WHEN starts_with({v}, '{a}_') OR {v} = '{a.replace('_', '')}' THEN '{a}'" for a in allowed)
    return f"CASE WHEN {v} IN ({', '.join(repr(a) for a in allowed)}) THEN {v} {arms} END"


@query(f"WITH {FACTS} SELECT id, {_closed_sql('seniority_level', S.SENIORITY)} AS level FROM facts")
def f14_closed_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "seniority_level").select("id", S.closed(F.col("seniority_level"), S.SENIORITY).alias("level"))


TRACKS = ("software_engineering", "technical_support", "business_analysis", "product_and_marketing", "solutions_and_implementation", "data_and_analytics", "revenue_operations", "business_systems", "business_operations")


@query(
    f"WITH {POSTINGS}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(trim(department)), '[^a-z0-9]+'), lambda x: x <> '' AND x <> 'and') AS w FROM postings), k AS (SELECT id, array_to_string(w, '_') AS k, array_to_string(w, '') AS j, len(w) AS n FROM w) SELECT id, CASE "
    + " ".join(f"WHEN k = '{t.replace('_and_', '_')}' OR j = '{t.replace('_and_', '').replace('_', '')}' OR (n > 1 AND starts_with('{t.replace('_and_', '_')}', k || '_')) THEN '{t}'" for t in TRACKS)
    + " END AS track FROM k"
)
def f15_track(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "department").select("id", S.first_of_tokens(F.col("department"), TRACKS).alias("track"))


@query(f"WITH {POSTINGS} SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(title), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('senior','lead','sr','ii')), ' ') AS role FROM postings")
def f16_normalized_title(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "title").select("id", S.normalized_title(F.col("title"), ["senior", "lead", "sr", "ii"]).alias("role"))


@query(f"WITH {POSTINGS}, t AS (SELECT unnest(regexp_extract_all(lower(title), '[a-z][a-z0-9+#.\\-]{{1,}}')) AS w FROM postings) SELECT w, count(*) AS n FROM t WHERE length(w) > 2 AND w NOT IN ('and','the','for') GROUP BY 1")
def f17_tokenize(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z][a-z0-9+#.\-]{1,}"), F.lit(0)))
    return postings(spark, d, "title").select(words.alias("w")).where("length(w) > 2 and w not in ('and', 'the', 'for')").groupBy("w").agg(F.count("*").alias("n"))


@query()
def f18_segment_score(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "title", "location_raw", "department")
    seg = F.explode(F.array_compact(F.array("title", "location_raw", "department")))
    return p.select("id", seg.alias("segment")).select("id", "segment", S.segment_score(F.col("segment")).alias("score"))


@query(f"WITH {FACTS} SELECT id, coalesce(salary, comp_currency || ' ' || nullif(concat_ws('-', CAST(floor(comp_min) AS BIGINT), CAST(floor(comp_max) AS BIGINT)), '')) AS salary_text FROM facts")
def f19_salary_text(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "salary", "comp_min", "comp_max", "comp_currency").select("id", S.salary_text(F.col("salary"), F.col("comp_min"), F.col("comp_max"), F.col("comp_currency")).alias("salary_text"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'From ' || format('{:,}', CAST(round(o_totalprice) AS BIGINT)) WHEN o_totalprice > 100000 THEN 'Up to ' || format('{:,}', CAST(round(o_totalprice) AS BIGINT)) ELSE o_orderpriority END AS label FROM orders")
def f20_comp_label(spark: SparkSession, d: str) -> DataFrame:
    v = F.round("o_totalprice").cast("bigint")
    low, high = F.when(F.col("o_totalprice") > 300000, v), F.when(F.col("o_totalprice").between(100000.000001, 300000), v)
    return table(spark, d, "orders").select("o_orderkey", S.comp_label(low, high, F.col("o_orderpriority")).alias("label"))


@query("""WITH c AS (SELECT company_id, trim(regexp_extract(company_token, '^[A-Za-z0-9_-]{2,}'), '.-') AS t, company_id % 4 AS k FROM companies WHERE company_token IS NOT NULL)
SELECT company_id, unnest(CASE k WHEN 0 THEN ['ashby', 'lever'] WHEN 1 THEN ['greenhouse'] WHEN 2 THEN ['workday'] ELSE ['recruitee', 'workable'] END) AS platform, t AS token, CASE k WHEN 2 THEN 'Careers' ELSE '' END AS site FROM c WHERE length(t) > 1""")
def f21_board_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Boards named by pages that link each of them more than once, in different case."""
    c = table(spark, d, "companies").where("company_token is not null").select("company_id", F.regexp_extract("company_token", "^[A-Za-z0-9_-]{2,}", 0).alias("t"), (F.col("company_id") % 4).alias("k"))
    link = lambda pattern: F.format_string(pattern, F.col("t"))
    two = lambda p: F.concat(link(p), F.lit(" "), F.lower(link(p)))
    page = F.when(F.col("k") == 0, F.concat(two('<a href="https://jobs.lever.co/%s">'), two('"https://jobs.ashbyhq.com/%s"'))).when(F.col("k") == 1, two("https://boards.greenhouse.io/embed/job_board?b=1&amp;for=%s'"))
    page = page.when(F.col("k") == 2, F.concat(link("https://%s.wd5.myworkdayjobs.com/en-US/Careers "), link("//%s.WD5.myworkdayjobs.com/careers"))).otherwise(F.concat(link("https://%s.recruitee.com/o/x "), two("https://apply.workable.com/%s/j/1")))
    return c.where(F.length(F.btrim("t", F.lit(".-"))) > 1).select("company_id", F.explode(S.board_signatures(page)).alias("x")).select("company_id", "x.platform", "x.token", "x.site")


@query(f"WITH {POSTINGS}, o AS (SELECT DISTINCT regexp_extract(job_url, '^(https?://[^/?#]+)', 1) AS origin FROM postings WHERE job_url IS NOT NULL) SELECT origin, unnest([origin || '/careers', origin || '/jobs', origin || '/about/careers']) AS url FROM o")
def f22_candidate_urls(spark: SparkSession, d: str) -> DataFrame:
    o = postings(spark, d, "job_url").where("job_url is not null").select(F.regexp_extract("job_url", "^(https?://[^/?#]+)", 1).alias("origin")).distinct()
    return o.select("origin", F.explode(F.transform(F.array(*[F.lit(x) for x in ("/careers", "/jobs", "/about/careers")]), lambda p: F.concat("origin", p))).alias("url"))


@query("SELECT DISTINCT 'FAILED:' || coalesce(platform, 'unknown') AS label FROM platforms")
def f23_dead_letter_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "platforms").select(F.concat(F.lit("FAILED:"), F.coalesce("platform", F.lit("unknown"))).alias("label")).distinct()


@query(f"WITH {POSTINGS} SELECT coalesce(regexp_full_match(posted_at, '\\d{{4}}-\\d{{2}}-\\d{{2}}(T\\d{{2}}:\\d{{2}}:\\d{{2}})?'), false) AS shaped, count(*) AS n FROM postings GROUP BY 1")
def f24_timestamp_shape(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.col("posted_at").rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$"), F.lit(False))
    return postings(spark, d, "posted_at").groupBy(ok.alias("shaped")).agg(F.count("*").alias("n"))


@query("SELECT ref_id, 'search_query:' || ref_id AS dataset, ref_id AS decoded FROM canonical_values")
def f25_dataset_codec(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "canonical_values").select("ref_id", F.concat(F.lit("search_query:"), "ref_id").alias("dataset"))
    return x.withColumn("decoded", F.regexp_extract("dataset", r"^search_query:(\d+)$", 1).try_cast("int"))


_AGO = "(?:(\\d+)\\+?|\\b(?:an?)\\b)\\s*(minute|hour|day|week|month)s?\\s*ago"


@query(f"""WITH {POSTINGS}, x AS (SELECT id, posted_at AS t, coalesce(try_cast(nullif(regexp_extract(posted_at, '{_AGO}', 1, 'i'), '') AS BIGINT), 1) AS n, lower(regexp_extract(posted_at, '{_AGO}', 2, 'i')) AS u FROM postings),
y AS (SELECT id, t, CASE u WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 WHEN 'week' THEN 604800 WHEN 'month' THEN 2592000 END * n AS s FROM x)
SELECT id, CASE WHEN s IS NOT NULL THEN TIMESTAMP '{NOW}' - to_seconds(s) WHEN regexp_matches(t, '\\byesterday\\b', 'i') THEN TIMESTAMP '2026-11-19' WHEN regexp_matches(t, '\\btoday\\b', 'i') THEN TIMESTAMP '2026-11-20' END AS at FROM y""")
def f30_relative_posted_at(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "posted_at").select("id", S.relative_instant(F.col("posted_at"), now()).cast("timestamp_ntz").alias("at"))


@query(f"WITH {POSTINGS} SELECT id, regexp_matches(posted_at, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') AS iso FROM postings WHERE posted_at IS NOT NULL")
def f31_iso_prefix(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "posted_at").where("posted_at is not null").select("id", F.col("posted_at").rlike(r"^\s*\d{4}-\d{2}-\d{2}").alias("iso"))


@query("SELECT o_orderkey, CAST(epoch(timezone('America/New_York', o_orderdate)) AS BIGINT) AS utc FROM orders")
def f32_to_utc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "America/New_York")).alias("utc"))


INSTANTS = [("2026-01-15T09:30:00", "1768487400"), ("2026-07-15", "1784088000"), ("1752570000", "1752570000"), ("5", None), ("2026-01-15T09:30:00+02:00", "1768462200"), ("2026-01-15T09:30:00Z", "1768469400"), ("junk", None), ("  ", None), (" 2026-01-15 09:30:00.25 ", "1768487400"), ("2026-02-30", None), ("2026-01-15T09:30", "1768487400")]


@query(_wanted([{"utc": w} for _, w in INSTANTS]))
def f32_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d, [r for r, _ in INSTANTS]).select("n", F.unix_timestamp(S.to_utc(F.col("raw"))).cast("string").alias("utc"))


@query("SELECT company_id, round(date_diff('second', first_validated_at, TIMESTAMP '2026-11-20 12:00:00') / 86400.0, 6) AS days FROM companies")
def f33_days_since(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("company_id", F.round(F.expr(f"timestampdiff(SECOND, first_validated_at, timestamp_ntz'{NOW}') / 86400.0"), 6).cast("double").alias("days"))


@query("SELECT DISTINCT o_orderdate::DATE AS day, CAST(epoch(timezone('America/New_York', date_trunc('day', o_orderdate))) AS BIGINT) AS start, CAST(epoch(timezone('America/New_York', date_trunc('day', o_orderdate) + INTERVAL 1 DAY)) AS BIGINT) AS stop FROM orders")
def f34_local_day_bounds(spark: SparkSession, d: str) -> DataFrame:
    day = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()

    def utc(c):
        return F.unix_timestamp(F.to_utc_timestamp(c.cast("timestamp"), "America/New_York"))

    return day.select("day", utc(F.col("day")).alias("start"), utc(F.date_add("day", 1)).alias("stop"))


@query(f"WITH {POSTINGS}, x AS (SELECT id, date_diff('second', try_strptime(last_seen, '%Y-%m-%dT%H:%M:%S'), TIMESTAMP '{NOW}') AS s FROM postings) SELECT id, CASE WHEN s IS NULL THEN NULL WHEN s <= 86400 THEN 'today' WHEN s <= 259200 THEN '3days' WHEN s <= 604800 THEN 'week' ELSE 'month' END AS chip FROM x")
def f35_date_chip(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "last_seen").select("id", S.date_chip(F.col("last_seen"), now()).alias("chip"))


@query("""WITH x AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), m AS (SELECT d, date_trunc('month', d)::DATE AS m FROM x),
r AS (SELECT d, m + (least(31, day(last_day(m))) - 1)::INT AS this, (m - INTERVAL 1 MONTH)::DATE + (least(31, day(last_day((m - INTERVAL 1 MONTH)::DATE))) - 1)::INT AS prev, (m + INTERVAL 1 MONTH)::DATE + (least(31, day(last_day((m + INTERVAL 1 MONTH)::DATE))) - 1)::INT AS nxt FROM m)
SELECT d AS day, CASE WHEN d >= this THEN this ELSE prev END AS start, date_diff('day', d, CASE WHEN d >= this THEN nxt ELSE this END) AS days_left FROM r""")
def f36_billing_cycle(spark: SparkSession, d: str) -> DataFrame:
    day = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    start, nxt = S.cycle_bounds(F.col("day"), 31)
    return day.select("day", start.alias("start"), F.datediff(nxt, "day").cast("bigint").alias("days_left"))


@query("SELECT company_id, CASE WHEN open_jobs IS NULL THEN NULL WHEN open_jobs <= 20 THEN 0 ELSE greatest(1, (open_jobs - 20) // 7) END::BIGINT AS allowance FROM companies")
def f37_run_allowance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("company_id", S.run_allowance(F.col("open_jobs"), F.lit(7), 20).cast("bigint").alias("allowance"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def f38_month_name_date(spark: SparkSession, d: str) -> DataFrame:
    written = F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    day = F.to_date(F.initcap("w"), "dd-MMM-yyyy")
    return table(spark, d, "orders").select("o_orderkey", written.alias("w")).select("o_orderkey", day.cast("string").alias("iso"))


@query(f"WITH {POSTINGS} SELECT id, strftime(make_timestamp(CAST(posted_at AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S') AS iso FROM postings WHERE regexp_full_match(posted_at, '\\d{{13}}')")
def f39_epoch_millis(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "posted_at").where(F.col("posted_at").rlike(r"^\d{13}$"))
    return p.select("id", F.date_format(F.timestamp_millis(F.col("posted_at").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(f"WITH {POSTINGS} SELECT id, CAST(epoch(strptime(substr(first_seen, 6), '%d %b %Y %H:%M:%S %z')) AS BIGINT) AS utc FROM postings WHERE regexp_matches(first_seen, '^[A-Z][a-z]{{2}}, \\d{{2}} ')")
def f40_rfc822(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "first_seen").where(F.col("first_seen").rlike(r"^[A-Z][a-z]{2}, \d{2} "))
    return p.select("id", F.unix_timestamp(F.try_to_timestamp(F.substring("first_seen", 6, 100), F.lit("dd MMM yyyy HH:mm:ss Z"))).alias("utc"))


_ISO = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?"


@query(rf"""WITH {POSTINGS}, r AS (SELECT id, trim(posted_at) AS p, trim(first_seen) AS f FROM postings),
x AS (SELECT id, CASE WHEN regexp_matches(p, '{_ISO}$') THEN epoch(TRY_CAST(p || 'Z' AS TIMESTAMPTZ)) WHEN regexp_matches(p, '{_ISO}(Z|[+-]\d\d:\d\d)$') THEN epoch(TRY_CAST(p AS TIMESTAMPTZ)) WHEN regexp_matches(p, '^\d{{4}}-\d\d-\d\d$') THEN epoch(TRY_CAST(p || 'T00:00:00Z' AS TIMESTAMPTZ)) WHEN regexp_matches(p, '^\d{{1,12}}$') AND TRY_CAST(p AS BIGINT) >= 946684800 THEN TRY_CAST(p AS DOUBLE) END AS a,
 CASE WHEN regexp_matches(f, '{_ISO}$') THEN epoch(TRY_CAST(f || 'Z' AS TIMESTAMPTZ)) WHEN regexp_matches(f, '{_ISO}(Z|[+-]\d\d:\d\d)$') THEN epoch(TRY_CAST(f AS TIMESTAMPTZ)) WHEN regexp_matches(f, '^\d{{4}}-\d\d-\d\d$') THEN epoch(TRY_CAST(f || 'T00:00:00Z' AS TIMESTAMPTZ)) WHEN regexp_matches(f, '^\d{{1,12}}$') AND TRY_CAST(f AS BIGINT) >= 946684800 THEN TRY_CAST(f AS DOUBLE) END AS b FROM r),
y AS (SELECT id, a IS NOT NULL AS exact, greatest(0, floor((epoch(TIMESTAMP '{{NOW}}') - floor(coalesce(a, b))) / 86400))::BIGINT AS days FROM x WHERE coalesce(a, b) IS NOT NULL)
SELECT id, days, exact, days > 30 AS stale FROM y""".replace("{NOW}", NOW))
def f41_posting_age(spark: SparkSession, d: str) -> DataFrame:
    """Age by the posting's own date, else by when it was first seen, and whether it is stale."""
    days, exact = S.posting_age(F.col("posted_at"), F.col("first_seen"), now())
    return postings(spark, d, "posted_at", "first_seen").select("id", days.cast("bigint").alias("days"), exact.alias("exact")).where("days is not null").withColumn("stale", F.col("days") > 30)


@query("SELECT c_custkey, CAST(greatest(0, least(100, round_even(c_acctbal / 50, 0))) AS INT) AS score FROM customer")
def f50_clamp_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.clamp_score(F.col("c_acctbal") / 50).alias("score"))


@query(f"WITH {FACTS}, x AS (SELECT id, CAST(trunc(try_cast(regexp_extract(salary, '[0-9.]+') AS DOUBLE)) AS BIGINT) AS n FROM facts) SELECT id, CASE WHEN n BETWEEN 0 AND 500 THEN n END AS n FROM x")
def f51_int_in_range(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "salary").select("id", S.int_in_range(F.regexp_extract("salary", "[0-9.]+", 0), 0, 500).alias("n"))


@query("SELECT event_id, CASE props WHEN '{\"k\": 1}' THEN true END AS flag FROM events")
def f52_tristate_bool(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.get_json_object("props", "$.k") == "1", '{"b": true}').otherwise('{"b": "yes"}')
    return table(spark, d, "events").select("event_id", F.from_json(raw, "b boolean").getField("b").alias("flag"))


@query(f"WITH {FACTS} SELECT id, CASE WHEN comp_min IS NOT NULL AND comp_max IS NOT NULL THEN least(comp_min, comp_max) ELSE comp_min END AS low, CASE WHEN comp_min IS NOT NULL AND comp_max IS NOT NULL THEN greatest(comp_min, comp_max) ELSE comp_max END AS high FROM facts")
def f53_swap_reversed(spark: SparkSession, d: str) -> DataFrame:
    both = F.col("comp_min").isNotNull() & F.col("comp_max").isNotNull()
    return facts(spark, d, "comp_min", "comp_max").select("id", F.when(both, F.least("comp_min", "comp_max")).otherwise(F.col("comp_min")).alias("low"), F.when(both, F.greatest("comp_min", "comp_max")).otherwise(F.col("comp_max")).alias("high"))


@query(f"WITH {FACTS} SELECT id FROM facts WHERE seniority_level IS NULL AND (role_archetype IS NULL OR role_archetype = 'other') AND salary IS NULL")
def f54_says_nothing(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "seniority_level", "role_archetype", "salary").where("seniority_level is null and (role_archetype is null or role_archetype = 'other') and salary is null").select("id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f55_tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Here you go:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(S.tolerant_json(answer), "$.k").cast("bigint").alias("k"))


@query("SELECT ref_id, to_json(list_sort(list_distinct(list_transform(string_split(alt_names, '|'), lambda x: lower(trim(x))))))::VARCHAR AS names FROM canonical_values WHERE alt_names IS NOT NULL")
def f56_sorted_list_json(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform(F.split("alt_names", r"\|"), lambda x: F.lower(F.trim(x)))))
    return table(spark, d, "canonical_values").where("alt_names is not null").select("ref_id", F.to_json(names).alias("names"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS warned FROM events")
def f57_corrupt_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int", {"mode": "PERMISSIVE"}).getField("k")
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(k.isNull()).alias("warned"))


@query("SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: contains(lower(x), 'an'))) > 0 AS has FROM part")
def f58_contains_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.exists(F.split("p_type", " "), lambda x: F.contains(F.lower(x), F.lit("an"))).alias("has"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f60_json_column(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS present FROM events")
def f62_path_present(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.path_present("k")("props").alias("present"))
