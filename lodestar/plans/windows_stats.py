"""Queries of windows, paging, rule scoring, statistics and text mining."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.operators import gate, rules, stats, textmine, timestamps
from lodestar.plans.common import CRITERIA, FACT_SQL, FACTS, FLAGS, GATE, JOB_NO_SQL, LOG, POSTINGS, SCORED, STOPPED_SQL, TIER_SQL, extracted, facts, job_no, log, parts_sql, postings

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scorable(spark: SparkSession, d: str) -> DataFrame:
    """Distinct fact rows with their posting's columns and the facts worked out of its texts."""
    lvl = F.lower("seniority_level")
    f = facts(spark, d, "seniority_level", "role_archetype", "remote_policy", "employment_type").withColumn("seniority_level", F.when(lvl.isin(*rules.SENIORITY), lvl))
    return extracted(f.join(postings(spark, d, "platform", "company_name", "title", "description_text", "first_seen", "location_is_nyc", "location_is_remote"), "id"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Facts scored by CRITERIA."""
    return rules.score(scorable(spark, d), CRITERIA, FLAGS)


# windows


@query(f"WITH {POSTINGS} SELECT platform, id FROM (SELECT platform, id, row_number() OVER (PARTITION BY platform ORDER BY last_seen DESC, id) AS rn FROM postings) WHERE rn <= 5")
def w1_per_group_topn(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("platform").orderBy(F.desc("last_seen"), "id")
    return postings(spark, d, "platform", "last_seen").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("platform", "id")


@query("SELECT ref_id, row_number() OVER (PARTITION BY ref_field ORDER BY ref_id) - 1 AS position FROM canonical_values")
def w2_position(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_values").select("ref_id", (F.row_number().over(Window.partitionBy("ref_field").orderBy("ref_id")) - 1).alias("position"))


@query("WITH s AS (SELECT labeller_id, min(labelled_at) AS started FROM eval_labels GROUP BY 1) SELECT labeller_id, dense_rank() OVER (ORDER BY started, labeller_id) - 1 AS rank FROM s")
def w3_dense_rank(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "eval_labels").groupBy("labeller_id").agg(F.min("labelled_at").alias("started"))
    return s.select("labeller_id", (F.dense_rank().over(Window.orderBy("started", "labeller_id")) - 1).alias("rank"))


@query("""WITH m AS (SELECT job_id, row_number() OVER (ORDER BY job_id) - 1 AS pos FROM (SELECT DISTINCT job_id FROM eval_labels WHERE label_set = 'set-00-1')),
n AS (SELECT count(*) AS n FROM m), mine AS (SELECT DISTINCT job_id FROM eval_labels WHERE labeller_id = 'lab-00-003'),
q AS (SELECT job_id, CASE WHEN pos < 3 THEN 0 ELSE 1 END AS band, CASE WHEN pos < 3 THEN pos ELSE (pos - 3 - 5 + (n - 3)) % (n - 3) END AS ord FROM m, n)
SELECT job_id, band, ord::BIGINT AS ord FROM q WHERE job_id NOT IN (SELECT job_id FROM mine) ORDER BY band, ord LIMIT 5""")
def w4_rotated_queue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels").select("label_set", "job_id", "labeller_id")
    m = e.where("label_set = 'set-00-1'").select("job_id").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("job_id")) - 1).cast("bigint"))
    m = m.crossJoin(F.broadcast(m.agg(F.count("*").alias("n"))))
    q = m.withColumn("band", F.when(F.col("pos") < 3, 0).otherwise(1)).withColumn("ord", F.when(F.col("pos") < 3, F.col("pos")).otherwise(F.pmod(F.col("pos") - 8, F.col("n") - 3)))
    return q.join(e.where("labeller_id = 'lab-00-003'").select("job_id").distinct(), "job_id", "left_anti").select("job_id", "band", "ord").orderBy("band", "ord").limit(5)


@query("SELECT c_custkey, CAST((((c_custkey::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT) * 37) // 18446744073709551616::HUGEINT AS BIGINT) AS tail_offset FROM customer")
def w5_hash_offset(spark: SparkSession, d: str) -> DataFrame:
    two64 = "cast('18446744073709551616' as decimal(20,0))"
    h = F.expr(f"mod(cast(c_custkey as decimal(12,0)) * cast('11400714819323198485' as decimal(20,0)), {two64})")
    return table(spark, d, "customer").select("c_custkey", h.cast("decimal(20,0)").alias("h")).select("c_custkey", F.expr(f"cast(cast(h * 37bd as decimal(38,0)) div {two64} as bigint)").alias("tail_offset"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderpriority, round(o_totalprice / 1000)) - 1) / 2.0 AS avg_rank FROM orders")
def w6_average_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("v"))
    return o.select("o_orderkey", stats.average_rank(["o_orderpriority"], F.col("v")).alias("avg_rank"))


@query(f"WITH {SCORED}, page AS (SELECT id FROM scored ORDER BY match_score DESC, id LIMIT 20 OFFSET 40) SELECT s.id, row_number() OVER (ORDER BY s.match_score DESC, s.id) + 40 AS rank FROM scored s JOIN page USING (id)")
def w7_server_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy(F.desc("match_score"), "id")
    return scored(spark, d).select("id", "match_score").orderBy(F.desc("match_score"), "id").offset(40).limit(20).select("id", (F.row_number().over(w) + 40).alias("rank"))


@query(f"WITH {SCORED}, r AS (SELECT id, coalesce(role_archetype, '-') AS track, row_number() OVER (ORDER BY match_score DESC, id) AS rank FROM scored), g AS (SELECT *, min(rank) OVER (PARTITION BY track) AS best FROM r) SELECT id, track, rank, dense_rank() OVER (ORDER BY best) AS group_no FROM g WHERE rank <= 200")
def w8_grouped_by_best(spark: SparkSession, d: str) -> DataFrame:
    top = scored(spark, d).select("id", F.coalesce("role_archetype", F.lit("-")).alias("track"), "match_score").orderBy(F.desc("match_score"), "id").limit(200)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("match_score"), "id")))
    r = r.withColumn("best", F.min("rank").over(Window.partitionBy("track")))
    return r.select("id", "track", "rank", F.dense_rank().over(Window.orderBy("best")).alias("group_no"))


@query(f"WITH {POSTINGS}, r AS (SELECT id, platform, row_number() OVER (PARTITION BY platform ORDER BY id) AS rn FROM postings) SELECT id, platform FROM r ORDER BY rn, platform LIMIT 30")
def w9_round_robin(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("platform").orderBy("id")
    return postings(spark, d, "platform").withColumn("rn", F.row_number().over(w)).orderBy("rn", "platform").limit(30).select("id", "platform")


@query("SELECT id, closed_at FROM (SELECT id, closed_at, row_number() OVER (PARTITION BY id ORDER BY closed_at IS NULL DESC, closed_at DESC, loaded_at, snapshot_no) AS rn FROM job_snapshots) WHERE rn = 1")
def w10_keep_best(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("closed_at").isNull().desc(), F.desc("closed_at"), "loaded_at", "snapshot_no")
    return table(spark, d, "job_snapshots").select("id", "closed_at", "loaded_at", "snapshot_no").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "closed_at")


@query("SELECT lower(ats) AS ats, lower(company_token) AS token, min(company_id) AS company_id FROM companies WHERE company_token IS NOT NULL GROUP BY 1, 2")
def w11_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").where("company_token is not null").groupBy(F.lower("ats").alias("ats"), F.lower("company_token").alias("token")).agg(F.min("company_id").alias("company_id"))


@query("WITH s AS (SELECT id, snapshot_no, arg_max(status, loaded_at) AS status, max(taken_at) AS taken_at FROM job_snapshots GROUP BY 1, 2), c AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY snapshot_no) AS prev FROM s) SELECT id, max(taken_at) FILTER (WHERE prev IS NULL OR prev <> status) AS changed_at FROM c GROUP BY 1")
def w12_change_tracking(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").select("id", "snapshot_no", "loaded_at", "status", "taken_at").repartition("id").groupBy("id", "snapshot_no").agg(F.max_by("status", "loaded_at").alias("status"), F.max("taken_at").alias("taken_at"))
    prev = F.lag("status").over(Window.partitionBy("id").orderBy("snapshot_no"))
    return s.withColumn("prev", prev).groupBy("id").agg(F.max(F.when(F.col("prev").isNull() | (F.col("prev") != F.col("status")), F.col("taken_at"))).alias("changed_at"))


# ordering and paging


@query(f"""WITH {SCORED}, {LOG}, tiers AS (SELECT id, {JOB_NO_SQL} AS job_no, {TIER_SQL} AS tier FROM postings),
mine AS (SELECT job_id, bool_or(ev = 'impression') AS seen, arg_max(ev, (ts, event_id)) FILTER (WHERE ev IN ('save', 'unsave')) = 'save' AS saved FROM log WHERE user_id = 7 GROUP BY 1),
ranked AS (SELECT s.id, s.platform, s.match_score, coalesce(m.seen, false) AS seen, coalesce(m.saved, false) AS saved
  FROM scored s JOIN tiers t USING (id) LEFT JOIN mine m ON m.job_id = t.job_no WHERE t.tier <= 2)
SELECT count(*) AS listed, count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE saved) AS saved, sum(match_score)::BIGINT AS total FROM ranked""")
def l1_gated_list(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the whole gated list with a user's state: what the ranked list draws its pages from."""
    return _gated(spark, d).agg(F.count("*").alias("listed"), F.count_if("seen").alias("seen"), F.count_if("saved").alias("saved"), F.sum("match_score").alias("total"))


def _gated(spark: SparkSession, d: str, user: int = 7) -> DataFrame:
    """Scored postings that pass the gate, with whether the user saw them and has them saved."""
    x = scorable(spark, d)
    x = rules.score(x.where(gate.tier(GATE, x.columns) <= GATE["max_tier"]), CRITERIA, FLAGS)
    state = log(spark, d).where(F.col("user_id") == user).groupBy("job_id").agg(F.bool_or(F.col("ev") == "impression").alias("seen"), (F.max_by(F.when(F.col("ev").isin("save", "unsave"), F.col("ev")), F.when(F.col("ev").isin("save", "unsave"), F.struct("ts", "event_id"))) == "save").alias("saved"))
    no = F.lit(False)
    return x.withColumn("job_id", job_no(F.col("id"))).join(state, "job_id", "left").withColumns({"seen": F.coalesce("seen", no), "saved": F.coalesce("saved", no)})


@query()
def l1_ranked_list(spark: SparkSession, d: str) -> DataFrame:
    """First page of a user's list: gated, scored, newest instant first among equals, with seen and saved state."""
    instants = timestamps.normalize_timestamps(table(spark, d, "jobs"), table(spark, d, "platforms")).where("field_name = 'first_seen'").groupBy("id").agg(F.max("utc_seconds").alias("first_seen_at"))
    x = _gated(spark, d).join(instants, "id", "left")
    order = [F.desc("match_score"), F.desc_nulls_last("first_seen_at"), F.asc("id")]
    top = x.select("id", "platform", "match_score", "seen", "saved", "first_seen_at").orderBy(*order).limit(25)
    return top.select("*", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query(f"WITH {SCORED}, k AS (SELECT match_score AS s, id AS i FROM scored ORDER BY match_score DESC, id LIMIT 1 OFFSET 24), page AS (SELECT scored.id, scored.match_score FROM scored, k WHERE match_score < s OR (match_score = s AND id > i) ORDER BY match_score DESC, id LIMIT 26) SELECT id, match_score FROM page ORDER BY match_score DESC, id LIMIT 25")
def l2_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("id", "match_score")
    first = s.orderBy(F.desc("match_score"), "id").limit(25)
    key = first.agg(F.max(F.struct((-F.col("match_score")).alias("s"), F.col("id").alias("i"))).alias("x")).select((-F.col("x.s")).alias("s"), "x.i")
    after = (F.col("match_score") < F.col("s")) | ((F.col("match_score") == F.col("s")) & (F.col("id") > F.col("i")))
    return s.crossJoin(F.broadcast(key)).where(after).select("id", "match_score").orderBy(F.desc("match_score"), "id").limit(25)


@query("SELECT company_id, open_jobs IS NOT NULL AS done FROM companies ORDER BY open_jobs IS NOT NULL, open_jobs DESC, company_id LIMIT 40")
def l3_boolean_first(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("open_jobs").isNotNull()
    return table(spark, d, "companies").orderBy(done, F.desc("open_jobs"), "company_id").limit(40).select("company_id", done.alias("done"))


@query("SELECT company_id FROM companies ORDER BY open_jobs ASC NULLS FIRST, company_id LIMIT 40")
def l4_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").orderBy(F.asc_nulls_first("open_jobs"), "company_id").limit(40).select("company_id")


@query("SELECT company_id, ats FROM (SELECT company_id, ats, first_validated_at AS v, row_number() OVER (PARTITION BY ats ORDER BY first_validated_at, company_id) AS rn FROM companies) WHERE rn <= 3 AND v <= TIMESTAMP '2026-01-01'")
def l5_stalest_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("ats").orderBy("first_validated_at", "company_id")
    return table(spark, d, "companies").withColumn("rn", F.row_number().over(w)).where("rn <= 3 and first_validated_at <= timestamp_ntz'2026-01-01'").select("company_id", "ats")


@query("SELECT company_id FROM companies ORDER BY first_validated_at, company_id LIMIT 10")
def l6_least_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").orderBy(F.asc("first_validated_at"), "company_id").limit(10).select("company_id")


@query("SELECT company_id FROM companies WHERE status = 'active' AND first_validated_at < TIMESTAMP '2025-06-01' ORDER BY coalesce(open_jobs, 0) DESC, company_id LIMIT 15")
def l7_budgeted_due(spark: SparkSession, d: str) -> DataFrame:
    due = table(spark, d, "companies").where("status = 'active' and first_validated_at < timestamp_ntz'2025-06-01'")
    return due.orderBy(F.desc(F.coalesce("open_jobs", F.lit(0))), "company_id").limit(15).select("company_id")


@query(f"WITH {POSTINGS} SELECT id FROM postings ORDER BY md5('11' || id), id LIMIT 20")
def l8_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "status").orderBy(F.md5(F.concat(F.lit("11"), "id")), "id").limit(20).select("id")


@query("WITH o AS (SELECT o_orderkey, o_totalprice AS a, o_custkey AS b FROM orders), x AS (SELECT o_orderkey FROM o ORDER BY a DESC, o_orderkey LIMIT 2000), y AS (SELECT o_orderkey FROM o ORDER BY b DESC, o_orderkey LIMIT 2000) SELECT count(*) / 2000.0 AS overlap FROM x JOIN y USING (o_orderkey)")
def l10_topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_overlap(table(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_custkey", 2000)


@query("WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS rn FROM orders) SELECT count(*) FILTER (WHERE o_totalprice > 400000) AS positives, count(*) FILTER (WHERE o_totalprice > 400000 AND rn <= 3000) AS found FROM r")
def l11_recall_in_window(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    top = o.orderBy(F.desc("o_custkey"), "o_orderkey").limit(3000)
    return o.agg(F.count_if(F.col("o_totalprice") > 400000).alias("positives")).crossJoin(top.agg(F.count_if(F.col("o_totalprice") > 400000).alias("found")))


# rules


@query(f"WITH {SCORED} SELECT id, match_score FROM scored")
def m1_rule_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", "match_score")


@query(f"""WITH {POSTINGS}, {FACTS}, {FACT_SQL}, profiles(profile, b, ceiling, backend, remote) AS (VALUES ('one', 50, 4, 20, true), ('two', 35, 10, 40, false), ('three', 60, 0, -100, true)),
parts AS (SELECT *, {parts_sql("ceiling", "backend", "remote")} FROM base, profiles)
SELECT id, profile, CASE WHEN {STOPPED_SQL} THEN 0 ELSE greatest(0, least(100, b + dl + dy + dr + da + dt + dp + dm + df)) END AS match_score FROM parts""")
def m1_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every posting scored for every profile of a table, in one plan."""
    rows = []
    for name, base, ceiling, backend, remote in (("one", 50, 4, 20, True), ("two", 35, 10, 40, False), ("three", 60, 0, -100, True)):
        c = CRITERIA | {"base": base, "years_experience": CRITERIA["years_experience"] | {"max_required": ceiling}, "archetypes": CRITERIA["archetypes"] | {"backend": backend}, "location": CRITERIA["location"] | {"accept_remote": remote}}
        rows.append((name, json.dumps(c)))
    return rules.score_profiles(scorable(spark, d), spark.createDataFrame(rows, "profile string, criteria string"), FLAGS).select("id", "profile", "match_score")


@query(f"""WITH {SCORED}, x AS (SELECT 'base' AS family, 50 AS delta FROM scored UNION ALL SELECT 'seniority', dl FROM scored UNION ALL SELECT 'years', dy FROM scored WHERE dl > -100 UNION ALL SELECT 'archetype', dr FROM scored WHERE dl > -100
UNION ALL SELECT 'ai', da FROM scored WHERE dl > -100 AND dr > -100 UNION ALL SELECT unnest(['tech', 'location', 'remote', 'flag']), unnest([dt, dp, dm, df]) FROM scored WHERE NOT ({STOPPED_SQL}))
SELECT family, count(*) AS n, sum(delta)::DOUBLE AS total FROM x WHERE delta <> 0 GROUP BY 1""")
def a17_reason_totals(spark: SparkSession, d: str) -> DataFrame:
    r = scored(spark, d).select(F.explode("match_reasons").alias("r")).select(F.substring_index("r.rule", ":", 1).alias("family"), F.col("r.delta").alias("delta"))
    return r.groupBy("family").agg(F.count("*").alias("n"), F.sum("delta").alias("total"))


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE match_score = 50 + dl + dy + dr + da + dt + dp + dm + df AND NOT (dl <= -100 OR dr <= -100 OR da <= -100)) AS exact, count(*) FILTER (WHERE match_score = 0) AS zero FROM scored")
def m2_reasons_sum(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("t", F.aggregate("match_reasons", F.lit(0.0), lambda a, r: a + r["delta"]))
    return s.agg(F.count("*").alias("n"), F.count_if((F.col("t") == F.col("match_score")) & ~F.exists("match_reasons", lambda r: r["delta"] <= rules.HARD_EXCLUDE_AT)).alias("exact"), F.count_if(F.col("match_score") == 0).alias("zero"))


@query(f"WITH {SCORED} SELECT match_score >= 40 AS stored, count(*) AS n, avg(match_score) AS mean FROM scored GROUP BY 1")
def m3_floor(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy((F.col("match_score") >= 40).alias("stored")).agg(F.count("*").alias("n"), F.avg("match_score").alias("mean"))


@query(f"""WITH {SCORED} SELECT id, concat_ws(';', CASE WHEN dl > -100 AND dr > 0 THEN 'archetype:' || role_archetype END, CASE WHEN dl > -100 AND dr > -100 AND da > 0 THEN 'ai:' || ai END,
CASE WHEN NOT ({STOPPED_SQL}) AND dt > 0 THEN 'tech' END) AS phrases FROM scored""")
def f61_positive_phrases(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", F.array_join(rules.phrases(F.col("match_reasons")), ";").alias("phrases"))


# text mining

_TOKENS = "tok AS (SELECT p_partkey AS k, p_brand AS g, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z][a-z0-9+#.\\-]{1,}')) AS term FROM part), tokens AS (SELECT * FROM tok WHERE length(term) > 2)"
_TFIDF = f"""{_TOKENS}, tf AS (SELECT k, term, count(*) AS tf FROM tokens GROUP BY 1, 2), n AS (SELECT count(DISTINCT k) AS n FROM tokens),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT k, term, (1 + ln(tf)) * ln(n::DOUBLE / df) AS r FROM tf JOIN df USING (term), n WHERE df >= 2 AND df <= 0.5 * n),
v AS (SELECT k, term, r / nullif(sqrt(sum(r * r) OVER (PARTITION BY k)), 0) AS w FROM raw)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return textmine.terms(p, "k", "t")


@query(f"WITH {_TFIDF} SELECT k, term, round(w, 6) AS w FROM v")
def m4_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return textmine.tfidf(_tokens(spark, d), "k").select("k", "term", F.round("w", 6).alias("w"))


@query(f"WITH {_TOKENS}, dd AS (SELECT DISTINCT k, g, term FROM tokens), s AS (SELECT g, count(DISTINCT k) AS n_in FROM dd GROUP BY 1), a AS (SELECT term, count(DISTINCT k) AS c_all FROM dd GROUP BY 1), i AS (SELECT g, term, count(*) AS inside FROM dd GROUP BY 1, 2) SELECT g, term, inside, round((inside::DOUBLE / n_in - c_all::DOUBLE / (SELECT count(DISTINCT k) FROM dd)) * ln(1 + inside), 6) AS score FROM i JOIN a USING (term) JOIN s USING (g) WHERE inside::DOUBLE / n_in > 1.2 * (c_all::DOUBLE / (SELECT count(DISTINCT k) FROM dd))")
def m7_discriminating_terms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    t = F.regexp_extract_all(F.lower("t"), F.lit(r"[a-z][a-z0-9+#.\-]{1,}"), F.lit(0))
    tokens = p.select("k", "g", F.explode(t).alias("term")).where("length(term) > 2")
    return textmine.discriminating_terms(tokens, "k", "g", 1.2).select("g", "term", "inside", F.round("score", 6).alias("score"))


@query(f"WITH {POSTINGS} SELECT company_token, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS t, count(*) AS n, min(id) AS id FROM postings GROUP BY 1, 2")
def m8_collapse_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("title"), r"\(.*?\)", " "), "[^a-z0-9 ]", " "), r"\s+", " "))
    return postings(spark, d, "company_token", "title").groupBy("company_token", t.alias("t")).agg(F.count("*").alias("n"), F.min("id").alias("id"))


@query("SELECT count(*) FILTER (WHERE regexp_matches(text, 'kubernetes', 'i')) AS a, count(*) FILTER (WHERE regexp_matches(text, 'python|scala', 'i')) AS b, count(*) FILTER (WHERE regexp_matches(text, 'kubernetes', 'i') OR regexp_matches(text, 'python|scala', 'i')) AS either FROM documents")
def m9_vocabulary_probe(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("text").rlike("(?i)kubernetes"), F.col("text").rlike("(?i)python|scala")
    return table(spark, d, "documents").agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a | b).alias("either"))


@query(f"WITH {POSTINGS}, s AS (SELECT id, platform, CASE WHEN location_is_remote THEN 'remote' WHEN location_is_nyc THEN 'nyc' ELSE 'other' END AS stratum FROM postings), r AS (SELECT *, row_number() OVER (PARTITION BY stratum, platform ORDER BY sha256('7|' || id)) AS rn FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rn, platform, id) AS pick FROM r) SELECT id, stratum FROM q WHERE pick <= CASE stratum WHEN 'other' THEN 20 ELSE 10 END")
def m11_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    s = postings(spark, d, "platform", "location_is_remote", "location_is_nyc").withColumn("stratum", F.when(F.col("location_is_remote"), "remote").when(F.col("location_is_nyc"), "nyc").otherwise("other"))
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("stratum", "platform").orderBy(F.sha2(F.concat(F.lit("7|"), "id"), 256)))).where("rn <= 20")
    q = r.withColumn("pick", F.row_number().over(Window.partitionBy("stratum").orderBy("rn", "platform", "id")))
    return q.where(F.col("pick") <= F.when(F.col("stratum") == "other", 20).otherwise(10)).select("id", "stratum")


# statistics

_SL = "sl AS (SELECT c_mktsegment AS g, floor(c_acctbal / 500) AS score, c_nationkey < 7 AS label FROM customer)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), F.floor(F.col("c_acctbal") / 500).alias("score"), (F.col("c_nationkey") < 7).alias("label"), "c_acctbal", "c_nationkey")


@query("WITH x AS (SELECT c_mktsegment AS g, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS k FROM customer GROUP BY 1), p AS (SELECT *, k::DOUBLE / n AS p, 1.959963984540054 AS z FROM x) SELECT g, round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS high FROM p")
def r1_wilson(spark: SparkSession, d: str) -> DataFrame:
    x = _scores(spark, d).groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return x.select("g", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("WITH c AS (SELECT field, job_id, lower(trim(value)) AS v, count(*) AS c FROM eval_labels WHERE value IS NOT NULL GROUP BY ALL), i AS (SELECT field, job_id, sum(c) AS m, count(*) AS kinds, sum(c * (c - 1)) AS same FROM c GROUP BY ALL HAVING sum(c) > 1) SELECT field, count(*) AS items, round(avg((kinds = 1)::INT), 6) AS unanimous, round(avg(same / (m * (m - 1))), 6) AS pairwise FROM i GROUP BY 1")
def r2_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels").select("field", "job_id", F.lower(F.trim("value")).alias("v"))
    return stats.agreement(e, ["job_id"], "v", ["field"]).select("field", "items", F.round("unanimous", 6).alias("unanimous"), F.round("pairwise", 6).alias("pairwise"))


@query("WITH r AS (SELECT c_mktsegment AS g, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS y FROM customer) SELECT g, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def r3_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_scores(spark, d), ["g"], "c_acctbal", "c_nationkey").select("g", "n", F.round("rho", 6).alias("rho"))


@query(f"WITH {_SL}, c AS (SELECT g, score, count(*) AS c FROM sl GROUP BY 1, 2) SELECT g, sum(c)::BIGINT AS n, count(*) AS kinds, max(c) AS largest, round(sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)), 6) AS p_tie FROM c GROUP BY 1")
def r4_tie_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.tie_histogram(_scores(spark, d), ["g"], "score").withColumn("p_tie", F.round("p_tie", 6))


_BLOCKS = f"""{_SL}, b AS (SELECT g, score, count(*) AS size, count(*) FILTER (WHERE label) AS hits FROM sl GROUP BY 1, 2),
blocks AS (SELECT *, coalesce(sum(size) OVER w, 0) AS above, coalesce(sum(hits) OVER w, 0) AS hits_above FROM b WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_BLOCKS}, x AS (SELECT *, unnest(range(1, size + 1)) AS i FROM blocks WHERE hits > 0),
s AS (SELECT g, sum(hits::DOUBLE / size * (hits_above + 1 + CASE WHEN size > 1 THEN (i - 1) * (hits - 1)::DOUBLE / (size - 1) ELSE 0 END) / (above + i)) AS e,
  sum(CASE WHEN i <= hits THEN (hits_above + i)::DOUBLE / (above + i) ELSE 0 END) AS o, sum(CASE WHEN i > size - hits THEN (hits_above + i - (size - hits))::DOUBLE / (above + i) ELSE 0 END) AS p FROM x GROUP BY 1),
t AS (SELECT g, sum(hits)::BIGINT AS positives FROM blocks GROUP BY 1)
SELECT g, positives, round(e / positives, 6) AS expected, round(o / positives, 6) AS optimistic, round(p / positives, 6) AS pessimistic FROM t JOIN s USING (g)""")
def r5_average_precision(spark: SparkSession, d: str) -> DataFrame:
    ap = stats.average_precision(_scores(spark, d), ["g"], "score", "label")
    return ap.select("g", "positives", *[F.round(c, 6).alias(c) for c in ("expected", "optimistic", "pessimistic")])


@query(f"WITH {_BLOCKS} SELECT g, round(sum(least(size, greatest(0, 20 - above)) * hits::DOUBLE / size) / 20, 6) AS precision FROM blocks GROUP BY 1")
def r6_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return stats.precision_at(_scores(spark, d), ["g"], "score", "label", 20).select("g", F.round("precision", 6).alias("precision"))


@query("SELECT o_orderpriority AS g, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.5), 6) AS p50 FROM orders GROUP BY 1")
def r7_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.round(F.percentile("o_totalprice", F.lit(0.9)), 6).alias("p90"), F.round(F.percentile("o_totalprice", F.lit(0.5)), 6).alias("p50"))


@query()
def r8_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), F.lit(4.0).alias("b"))
    return stats.paired_bootstrap(x, "c_custkey", "a", "b")


@query("SELECT o_orderpriority AS g, CASE WHEN avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)) > 0 THEN 'better' WHEN avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)) < 0 THEN 'worse' ELSE 'not distinguishable' END AS verdict FROM (SELECT o_orderpriority, o_totalprice - 250000 AS d FROM orders) GROUP BY 1")
def r9_verdict(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").withColumn("d", F.col("o_totalprice") - 250000).groupBy(F.col("o_orderpriority").alias("g")).agg(F.avg("d").alias("m"), (1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("h"))
    return x.select("g", stats.verdict(F.col("m") - F.col("h"), F.col("m") + F.col("h")).alias("verdict"))


@query("""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS r, l_quantity::DOUBLE AS v FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, id) <= 50 AS top FROM v), p AS (SELECT a.r AS ra, b.r AS rb, a.v AS va, b.v AS vb, a.top AS ta, b.top AS tb FROM t a JOIN t b USING (id) WHERE a.r < b.r),
k AS (SELECT *, rank() OVER (PARTITION BY ra, rb ORDER BY va) + (count(*) OVER (PARTITION BY ra, rb, va) - 1) / 2.0 AS x, rank() OVER (PARTITION BY ra, rb ORDER BY vb) + (count(*) OVER (PARTITION BY ra, rb, vb) - 1) / 2.0 AS y FROM p),
g AS (SELECT ra, rb, corr(x, y) AS rho, count(*) FILTER (WHERE ta AND tb) / 50.0 AS o FROM k GROUP BY 1, 2)
SELECT (SELECT round(avg(rho), 6) FROM g) AS spearman_mean, (SELECT round(min(rho), 6) FROM g) AS spearman_min, (SELECT round(avg(o), 6) FROM g) AS overlap_mean, (SELECT round(min(o), 6) FROM g) AS overlap_min, round(avg(abs(va - vb)), 6) AS mean_abs_diff, max(abs(va - vb)) AS max_abs_diff,
 round(avg((abs(va - vb) <= 0)::INT) FILTER (WHERE ra = 1 AND rb = 2), 6) AS within_0, round(avg((abs(va - vb) <= 5)::INT) FILTER (WHERE ra = 1 AND rb = 2), 6) AS within_5, round(avg((abs(va - vb) <= 10)::INT) FILTER (WHERE ra = 1 AND rb = 2), 6) AS within_10 FROM p""")
def r10_stability(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of an order's first three lines taken as three passes over the same records."""
    v = table(spark, d, "lineitem").where("l_linenumber <= 3").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v"))
    x = stats.stability(v, "l_orderkey", "l_linenumber", "v", 50)
    return x.select(*[c if c == "max_abs_diff" else F.round(c, 6).alias(c) for c in x.columns])


@query(f"WITH {POSTINGS}, a AS (SELECT job_id, field, lower(trim(value)) AS v FROM eval_labels WHERE round_no = 1), c AS (SELECT platform, field, job_id, v, count(*) AS c FROM a JOIN postings p ON p.id = a.job_id WHERE v IS NOT NULL GROUP BY ALL), i AS (SELECT platform, field, job_id, sum(c) AS m, sum(c * (c - 1)) AS same FROM c GROUP BY ALL HAVING sum(c) > 1) SELECT platform, field, count(*) AS items, round(avg(same / (m * (m - 1))), 6) AS pairwise FROM i GROUP BY 1, 2")
def r11_annotators_by_platform(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels").where("round_no = 1").select(F.col("job_id").alias("id"), "field", F.lower(F.trim("value")).alias("v"))
    return stats.agreement(e.join(postings(spark, d, "platform"), "id"), ["id"], "v", ["platform", "field"]).select("platform", "field", "items", F.round("pairwise", 6).alias("pairwise"))


@query("WITH v AS (SELECT job_id, lower(trim(value)) AS v, count(*) AS n FROM eval_labels WHERE field = 'seniority_level' AND value IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, max(n) OVER (PARTITION BY job_id) AS m FROM v), c AS (SELECT job_id, CASE WHEN count(*) = 1 THEN max(v) END AS label FROM t WHERE n = m GROUP BY 1), f AS (SELECT DISTINCT ON (id) id, lower(seniority_level) AS s FROM jobs_app) SELECT count(*) AS items, count(label) AS agreed, count(f.id) AS with_output, count(*) FILTER (WHERE f.s = label) AS same FROM c LEFT JOIN f ON f.id = c.job_id")
def r12_model_vs_human(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "eval_labels").where("field = 'seniority_level' and value is not null").groupBy(F.col("job_id").alias("id"), F.lower(F.trim("value")).alias("v")).agg(F.count("*").alias("n"))
    t = v.withColumn("m", F.max("n").over(Window.partitionBy("id"))).where("n = m").groupBy("id").agg(F.when(F.count("*") == 1, F.max("v")).alias("label"))
    f = facts(spark, d, "seniority_level").select("id", F.lower("seniority_level").alias("s"), F.lit(1).alias("has"))
    return t.join(f, "id", "left").agg(F.count("*").alias("items"), F.count("label").alias("agreed"), F.count("has").alias("with_output"), F.count_if(F.col("s") == F.col("label")).alias("same"))


@query("SELECT c_mktsegment AS g, count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey < 12) AS tp, count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey >= 12) AS fp, round(count(*) FILTER (WHERE c_acctbal > 0 AND c_nationkey < 12)::DOUBLE / nullif(count(*) FILTER (WHERE c_nationkey < 12), 0), 6) AS recall FROM customer GROUP BY 1")
def r15_gate_confusion(spark: SparkSession, d: str) -> DataFrame:
    said, true = F.col("c_acctbal") > 0, F.col("c_nationkey") < 12
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.round(F.try_divide(F.count_if(said & true), F.count_if(true)), 6).alias("recall"))


@query("WITH k AS (SELECT DISTINCT ON (id) id, lower(seniority_guess) AS key FROM jobs WHERE seniority_guess <> 'unknown'), f AS (SELECT DISTINCT ON (id) id, lower(seniority_level) AS s FROM jobs_app) SELECT key, count(*) AS n, count(*) FILTER (WHERE f.s = key) AS right FROM k LEFT JOIN f USING (id) GROUP BY 1")
def r16_field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    k = postings(spark, d, "seniority_guess").where("seniority_guess <> 'unknown'").select("id", F.lower("seniority_guess").alias("key"))
    f = facts(spark, d, "seniority_level").select("id", F.lower("seniority_level").alias("s"))
    return k.join(f, "id", "left").groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("s") == F.col("key")).alias("right"))


@query(f"WITH {SCORED}, y AS (SELECT *, role_archetype IN ('backend', 'data') AS good FROM scored), a AS (SELECT good FROM y ORDER BY match_score DESC, id LIMIT 50), b AS (SELECT good FROM y ORDER BY first_seen DESC NULLS LAST, id LIMIT 50) SELECT 'rules' AS baseline, (count(*) FILTER (WHERE good))::DOUBLE AS hits FROM a UNION ALL SELECT 'recency', count(*) FILTER (WHERE good) FROM b UNION ALL SELECT 'random', round(least(50, count(*)) * avg(coalesce(good, false)::INT), 6) FROM y")
def r17_baselines(spark: SparkSession, d: str) -> DataFrame:
    y = scored(spark, d).select("id", "match_score", "first_seen", F.coalesce(F.col("role_archetype").isin("backend", "data"), F.lit(False)).alias("good"))
    a = y.orderBy(F.desc("match_score"), "id").limit(50).agg(F.lit("rules").alias("baseline"), F.count_if("good").cast("double").alias("hits"))
    b = y.orderBy(F.desc_nulls_last("first_seen"), "id").limit(50).agg(F.lit("recency").alias("baseline"), F.count_if("good").cast("double").alias("hits"))
    # the mean over all random draws of that many rows, exactly
    c = y.agg(F.lit("random").alias("baseline"), F.round(F.least(F.lit(50), F.count("*")) * F.avg(F.col("good").cast("int")), 6).alias("hits"))
    return a.unionByName(b).unionByName(c)


@query("SELECT ats, round(count(company_token)::DOUBLE / count(*) * sum(coalesce(open_jobs, 0)) / 45.0 * 0.3, 6) AS per_day FROM companies GROUP BY 1")
def r18_yield_bound(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").groupBy("ats").agg(F.round(F.count("company_token") / F.count("*") * F.sum(F.coalesce("open_jobs", F.lit(0))) / 45.0 * 0.3, 6).alias("per_day"))
