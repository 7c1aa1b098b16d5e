"""Queries of voting, self-consistency, learned ranking, paging checks and the rest of the lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.functions import scalar as S
from lodestar.operators import gate, graphs, merge, ranker, stats, submissions, textmine, voting
from lodestar.plans.common import FACTS, LOG, POSTINGS, SCORED, facts, log, postings
from lodestar.plans.windows_stats import _BLOCKS, _TFIDF, _scores, _tokens, scored
from lodestar.session import scratch
from lodestar.sinks import writers
from lodestar.sources import feeds
from lodestar.streaming import engagement

QUERIES, ORACLE = {}, {}
#: Snapshots in order, each with the verdicts of its merge into the one before.
_SNAPS = """snaps AS (SELECT snapshot_no, id, lower(trim(arg_max(content_hash, loaded_at))) AS h, lower(trim(arg_max(status, loaded_at))) AS status FROM job_snapshots GROUP BY 1, 2),
nos AS (SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no) AS no FROM (SELECT DISTINCT snapshot_no FROM snaps)), o AS (SELECT s.*, n.no FROM snaps s JOIN nos n USING (snapshot_no)),
v AS (SELECT b.snapshot_no, CASE WHEN a.id IS NULL THEN 'new' WHEN a.h IS NOT DISTINCT FROM b.h AND a.status = 'open' THEN 'unchanged' ELSE 'updated' END AS verdict FROM o b LEFT JOIN o a ON a.id = b.id AND a.no = b.no - 1 WHERE b.no > 1)"""


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {POSTINGS} SELECT count(*) FILTER (WHERE regexp_matches(title, 'senior|lead', 'i') AND regexp_matches(title, 'engineer', 'i')) AS both, count(*) FILTER (WHERE regexp_matches(title, 'senior|lead|engineer', 'i')) AS flat FROM postings")
def pred2_include_groups(spark: SparkSession, d: str) -> DataFrame:
    def passes(patterns):
        g = gate.include_groups(patterns)
        out = F.lit(True)
        for x in g:
            out = out & gate.matches(F.col("title"), x)
        return out

    return postings(spark, d, "title").agg(F.count_if(passes([["senior", "lead"], ["engineer"], []])).alias("both"), F.count_if(passes(["senior", "lead", "engineer"])).alias("flat"))


@query(f"WITH {POSTINGS} SELECT count(*) AS n FROM postings WHERE regexp_matches(title, '\\bqa\\b', 'i')")
def pred5_word_boundary(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "title").where(gate.matches(F.col("title"), [r"\yqa\y"])).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT count(*) AS n FROM postings WHERE coalesce(location_is_nyc, false) OR coalesce(location_is_remote, false)")
def pred6_location_columns(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "location_is_nyc", "location_is_remote")
    return p.where(gate.location_ok(["location_is_nyc", "location_is_remote"], p.columns)).agg(F.count("*").alias("n"))


@query()
def s13_json_walk(spark: SparkSession, d: str) -> DataFrame:
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("jobPosting").alias("@type"), F.col("title")).alias("inner"))).alias("deep")))
    html = F.concat(F.lit('<script type="application/ld+json">'), nested, F.lit("</script>"))
    return feeds.json_ld_postings(postings(spark, d, "title").select("id", html.alias("h")), "h", "id").select("id", "title")


@query(f"WITH {POSTINGS} SELECT id, trim(string_split(company_name || ' | ' || title, '|')[1]) AS company FROM postings")
def n12_comment_records(spark: SparkSession, d: str) -> DataFrame:
    company, _ = feeds.comment_header(F.concat_ws(" | ", "company_name", "title", "location_raw"))
    return postings(spark, d, "company_name", "title", "location_raw").select("id", company.alias("company"))


@query()
def a15_field_votes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").groupBy("id", "snapshot_no").agg(F.max_by("status", "loaded_at").alias("status"), F.max_by("platform", "loaded_at").alias("platform"), F.max_by("title", "loaded_at").alias("title"), F.max(F.length("title")).alias("chars"))
    return voting.voted(s, "id", "snapshot_no", ["status", "platform"], ["chars"], "title")


@query("SELECT c_mktsegment AS g, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n, round(sum(k)::DOUBLE / sum(n), 6) AS rate FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS k FROM customer GROUP BY 1, 2) GROUP BY 1")
def a26_pooled_rate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g"), "c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    return voting.pooled_rate(c, ["g"], "k", "n").select("g", "k", "n", F.round("rate", 6).alias("rate"))


@query(f"WITH {_TFIDF} SELECT a.k AS a, b.k AS b, round(sum(a.w * b.w), 6) AS sim FROM v a JOIN v b ON a.term = b.term AND a.k < b.k GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.95")
def m5_cosine(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.session import materialize

    v = materialize(textmine.tfidf(_tokens(spark, d), "k"), "tfidf")
    return textmine.cosine_pairs(v, "k", 0.95).select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def m6_title_clusters(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.session import materialize

    t = S.normalized_title(F.col("title"), ["senior", "lead", "sr", "ii"])
    titles = materialize(postings(spark, d, "title").select(t.alias("k")).where("k <> ''").distinct(), "titles")
    v = materialize(textmine.tfidf(textmine.terms(titles.withColumn("t", F.col("k")), "k", "t"), "k"), "tfidf")
    edges = textmine.cosine_pairs(v, "k", 0.5).select(F.col("a").alias("u"), F.col("b").alias("v"), "sim")
    return graphs.average_linkage(edges, 0.5).select(F.col("node").alias("title"), "cluster")


@query()
def m10_learned_ranker(spark: SparkSession, d: str) -> DataFrame:
    y = facts(spark, d, "role_archetype", "remote_policy", "comp_min").join(postings(spark, d, "platform", "title"), "id").withColumn("good", F.col("comp_min").isNotNull())
    oof = ranker.out_of_fold(y, "id", ["platform", "remote_policy", "role_archetype"], "title", "good")
    return stats.average_precision(oof.withColumn("label", F.col("label") == 1), ["fold"], "p", "label").select("fold", "positives", "expected")


@query("WITH s AS (SELECT id, snapshot_no, arg_max(status, loaded_at) AS status, arg_max(title, loaded_at) AS title FROM job_snapshots GROUP BY 1, 2), x AS (SELECT id, 'status' AS field, status AS v FROM s UNION ALL SELECT id, 'title', title FROM s), r AS (SELECT id, field, count(DISTINCT v) = 1 AS one FROM x GROUP BY 1, 2 HAVING count(*) > 1) SELECT field, count(*) AS records, count(*) FILTER (WHERE one) AS stable FROM r GROUP BY 1")
def m12_self_consistency(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").groupBy("id", "snapshot_no").agg(F.max_by("status", "loaded_at").alias("status"), F.max_by("title", "loaded_at").alias("title"))
    return voting.self_consistency(s, "id", ["status", "title"]).select("field", "records", "stable")


@query("WITH a AS (SELECT field, avg((lower(trim(value)) = 'none')::INT) AS floor FROM eval_labels WHERE value IS NOT NULL GROUP BY 1), b AS (SELECT field, count(value) / count(*)::DOUBLE AS ceiling, count(*) FILTER (WHERE round_no = 1) / count(*)::DOUBLE AS measured FROM eval_labels GROUP BY 1) SELECT field, round(floor, 6) AS floor, round(ceiling, 6) AS ceiling, round(measured, 6) AS measured FROM a JOIN b USING (field)")
def r13_interpretable(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels")
    floor = e.where("value is not null").groupBy("field").agg(F.avg((F.lower(F.trim("value")) == "none").cast("int")).alias("value"))
    both = e.groupBy("field").agg((F.count("value") / F.count("*")).alias("c"), (F.count_if(F.col("round_no") == 1) / F.count("*")).alias("m"))
    t = voting.interpretable(floor, both.withColumnRenamed("c", "value"), both.withColumnRenamed("m", "value"), ["field"])
    return t.select("field", *[F.round(c, 6).alias(c) for c in ("floor", "ceiling", "measured")])


@query(f"""WITH {_BLOCKS}, p AS (SELECT g, sum(hits)::BIGINT AS positives, round(sum(least(size, greatest(0, 20 - above)) * hits::DOUBLE / size) / 20, 6) AS precision FROM blocks GROUP BY 1) SELECT g, positives, CASE WHEN g <> 'BUILDING' THEN precision END AS precision FROM p""")
def r14_ordering_report(spark: SparkSession, d: str) -> DataFrame:
    r = voting.ordering_report(_scores(spark, d), "g", "score", "label", 20, unranked=["BUILDING"])
    return r.select("g", "positives", F.round("precision", 6).alias("precision"))


@query(f"WITH {LOG} SELECT user_id, coalesce(arg_max(value, (ts, event_id)) FILTER (WHERE ev = 'open'), arg_max(value, (ts, event_id))) AS quota, max(ts) AS checked_in FROM log GROUP BY 1")
def t16_check_in(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    last_open = F.max(F.when(F.col("ev") == "open", F.struct("ts", "event_id", "value"))).getField("value")
    return log(spark, d).groupBy("user_id").agg(F.coalesce(last_open, F.max_by("value", at)).alias("quota"), F.max("ts").alias("checked_in"))


@query("SELECT ref_id, array_to_string(list_sort(list_distinct(string_split(coalesce(alt_names, ref_value), '|'))), '|') AS names FROM canonical_values")
def f59_as_set(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("alt_names").isNotNull(), F.to_json(F.split("alt_names", r"\|"))).otherwise(F.col("ref_value"))
    return table(spark, d, "canonical_values").select("ref_id", F.array_join(voting.as_set(text), "|").alias("names"))


@query("SELECT source, sha256('{\"max_repeats\":' || max_repeats || ',\"source\":\"' || source || '\"}') AS sha FROM mix_targets")
def f64_persona_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mix_targets").select("source", F.sha2(F.to_json(F.struct("max_repeats", "source")), 256).alias("sha"))


@query(f"WITH {SCORED}, x AS (SELECT count(*) AS n FROM scored WHERE match_score >= 40) SELECT least(n, 60) AS collected, n > 60 AS truncated FROM x")
def l9_full_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A client's crawl of the ranked list: pages of 20, three at most, and whether more was left."""
    top = scored(spark, d).where("match_score >= 40").select("id", "match_score").orderBy(F.desc("match_score"), "id").limit(61)
    return top.agg(F.least(F.count("*"), F.lit(60)).alias("collected"), (F.count("*") > 60).alias("truncated"))


@query("""SELECT CASE WHEN description_text IS NULL THEN 'no text' WHEN length(title) > 24 THEN 'long title' WHEN company_token NOT LIKE '%-%' THEN 'odd token' ELSE 'written' END AS reason, count(*) AS rows FROM posting_batches GROUP BY 1""")
def u15_validated_write(spark: SparkSession, d: str) -> DataFrame:
    checks = {"no text": F.col("description_text").isNotNull(), "long title": F.length("title") <= 24, "odd token": F.col("company_token").contains("-")}
    p = table(spark, d, "posting_batches").select("posting_no", "title", "company_token", "description_text")
    return submissions.write_validated(p, scratch(spark, "written"), checks).where("rows > 0")


@query("SELECT * FROM (VALUES (1, 'fill', true), (1, 'trim', true), (2, 'fill', false), (2, 'trim', false), (2, 'last', true)) AS t(run, pass, applied)")
def u23_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a list of passes, the second with one more: each pass is applied once."""
    ledger, out = scratch(spark, "ledger"), scratch(spark, "passes")

    def step(name: str):
        return lambda: table(spark, d, "mix_targets").select(F.lit(name).alias("by"), "source").write.mode("append").parquet(out)

    first = submissions.run_passes(spark, ledger, {n: step(n) for n in ("fill", "trim")})
    second = submissions.run_passes(spark, ledger, {n: step(n) for n in ("fill", "trim", "last")})
    applied = spark.read.schema("by string, source string").parquet(out).groupBy("by").agg(F.count("*").alias("n"))
    one = table(spark, d, "mix_targets").agg(F.count("*").alias("m"))
    runs = first.select(F.lit(1).alias("run"), "*").unionByName(second.select(F.lit(2).alias("run"), "*"))
    # a pass applied twice has written twice as many rows and drops out here
    return runs.join(applied.crossJoin(F.broadcast(one)).where("n = m").select(F.col("by").alias("pass")), "pass").select("run", "pass", "applied")


_RAW = """raw AS (SELECT posting_no, 'q' || (batch_no % 7) AS dataset, CASE WHEN posting_no % 11 = 0 THEN '{"title": "cut' WHEN posting_no % 13 = 0 THEN '{"n": 5}' ELSE '{"title": "t", "n": 1}' END AS body FROM posting_batches WHERE batch_no % 7 <> 3),
state AS (SELECT * FROM (VALUES ('q0', 'w0', 'a'), ('q1', 'w0', 'a'), ('q2', 'w0', 'b'), ('q3', 'w0', 'b'), ('q4', 'w0', NULL), ('q5', 'w0', 'c'), ('q6', 'w0', NULL), ('q9', 'w0', 'd')) AS t(dataset, watermark, holder)),
n AS (SELECT dataset, count(*) AS fetched, count(*) FILTER (WHERE posting_no % 11 <> 0 AND posting_no % 13 <> 0) AS accepted FROM raw GROUP BY 1)"""


def _submitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, state after settling): submissions for q0 to q6, q3 among them empty; q9 was not asked for."""
    n = F.col("posting_no")
    body = F.when(n % 11 == 0, '{"title": "cut').when(n % 13 == 0, '{"n": 5}').otherwise('{"title": "t", "n": 1}')
    raw = table(spark, d, "posting_batches").where("batch_no % 7 <> 3").select("posting_no", F.concat(F.lit("q"), F.col("batch_no") % 7).alias("dataset"), body.alias("body"))
    rows = submissions.parsed(raw, "body", "title string, n bigint", ["title"])
    state = spark.createDataFrame([("q0", "w0", "a"), ("q1", "w0", "a"), ("q2", "w0", "b"), ("q3", "w0", "b"), ("q4", "w0", None), ("q5", "w0", "c"), ("q6", "w0", None), ("q9", "w0", "d")], "dataset string, watermark string, holder string")
    return rows, submissions.settled(state, state.where("dataset <> 'q9'"), rows, F.lit("w1"))


@query(f"WITH {_RAW} SELECT dataset, fetched, accepted, fetched - accepted AS rejected FROM n")
def t13_parse_submission(spark: SparkSession, d: str) -> DataFrame:
    rows = _submitted(spark, d)[0]
    return rows.groupBy("dataset").agg(F.count("*").alias("fetched"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(f"WITH {_RAW} SELECT dataset, CASE WHEN fetched > 0 THEN 'w1' ELSE watermark END AS watermark, CASE WHEN dataset = 'q9' THEN holder END AS holder FROM state LEFT JOIN n USING (dataset)")
def t11_success_releases(spark: SparkSession, d: str) -> DataFrame:
    return _submitted(spark, d)[1].select("dataset", "watermark", "holder")


@query(f"WITH {_RAW} SELECT dataset, coalesce(fetched, 0) AS fetched, coalesce(fetched, 0) > 0 AS advanced, CASE WHEN fetched IS NULL AND dataset <> 'q9' THEN 'empty submission' END AS reason FROM state LEFT JOIN n USING (dataset)")
def t12_submission(spark: SparkSession, d: str) -> DataFrame:
    return _submitted(spark, d)[1].select("dataset", "fetched", "advanced", "reason")


@query(f"WITH {_RAW} SELECT dataset, 2 AS entries, 2 * coalesce(accepted, 0) AS accepted FROM state LEFT JOIN n USING (dataset) WHERE dataset <> 'q9'")
def t14_audit_append(spark: SparkSession, d: str) -> DataFrame:
    """The audit log after the same submissions were settled twice: entries are added, never replaced."""
    path = scratch(spark, "audit")
    entries = _submitted(spark, d)[1].where("dataset <> 'q9'").select("dataset", "fetched", "accepted", "rejected", "reason")
    submissions.append_audit(path, entries)
    audit = submissions.append_audit(path, entries)
    return audit.groupBy("dataset").agg(F.count("*").cast("int").alias("entries"), F.sum("accepted").alias("accepted"))


@query("SELECT batch_no, count(*) AS rows FROM posting_batches GROUP BY 1")
def t18_drain(spark: SparkSession, d: str) -> DataFrame:
    """A backlog drained in rounds of two batches until nothing is left: every row is worked off once."""
    backlog = scratch(spark, "backlog")
    table(spark, d, "posting_batches").select("posting_no", "batch_no").repartition("batch_no").write.partitionBy("batch_no").parquet(backlog)
    s = spark.readStream.schema("posting_no bigint, batch_no int").option("maxFilesPerTrigger", 2).parquet(backlog)
    return engagement.run_available(s, "drained").groupBy("batch_no").agg(F.count("*").alias("rows"))


@query(f"WITH {_SNAPS} SELECT v.snapshot_no, count(*) FILTER (WHERE verdict = 'new') AS new, count(*) FILTER (WHERE verdict = 'updated') AS updated, count(*) FILTER (WHERE verdict = 'unchanged') AS unchanged FROM v GROUP BY 1")
def k1_upsert_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the upsert of every snapshot into the one before it, all in one plan, as read back from their summary lines."""
    s = table(spark, d, "job_snapshots").groupBy("snapshot_no", "id").agg(F.max_by(F.struct("content_hash", "status"), "loaded_at").alias("x")).select("snapshot_no", "id", F.lower(F.trim("x.content_hash")).alias("h"), F.lower(F.trim("x.status")).alias("status"))
    nos = s.select("snapshot_no").distinct().withColumn("next", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))).where("next is not null")
    stored = s.join(F.broadcast(nos), "snapshot_no").select(F.struct(F.col("next").alias("snapshot_no"), "id").alias("key"), "h", "status")
    batch = s.join(F.broadcast(nos.select(F.col("next").alias("snapshot_no"))), "snapshot_no").select(F.struct("snapshot_no", "id").alias("key"), "h")
    v = merge.merge_verdicts(stored, batch, "key", "h", F.col("status") == "open").groupBy("key.snapshot_no").agg(*[F.count_if(F.col("verdict") == c).alias(c) for c in ("new", "updated", "unchanged")])
    line = writers.summary_line("jobs", F.col("new"), F.col("updated"), F.col("unchanged"), F.lit(0))
    counts = writers.parse_summary(line)
    return v.select("snapshot_no", *[F.element_at(counts, c).alias(c) for c in ("new", "updated", "unchanged")])
