"""Queries of predicates, joins, aggregates and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.operators import folds, gate
from lodestar.plans.common import FACTS, GATE, GATE_B, LOG, POSTINGS, TIER_SQL, facts, log, postings

GATED = ("title", "description_text", "company_name", "platform", "location_is_nyc", "location_is_remote")
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# predicates


@query(f"WITH {POSTINGS} SELECT {TIER_SQL} AS tier, count(*) AS n FROM postings GROUP BY 1")
def pred1_tier_gate(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, *GATED)
    return p.groupBy(gate.tier(GATE, p.columns).alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT id FROM postings WHERE ({TIER_SQL}) <= 2 OR (regexp_matches(title, '\\bnurse\\b|\\bplanner\\b', 'i') AND coalesce(location_is_remote, false))")
def pred3_union_gate(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, *GATED)
    return p.where(gate.union_gate([GATE, GATE_B], p.columns)).select("id")


@query(f"WITH {POSTINGS}, n AS (SELECT CASE WHEN platform = 'lever' THEN NULL ELSE title END AS t FROM postings) SELECT CASE WHEN NOT regexp_matches(t, 'lead', 'i') THEN 'no' WHEN regexp_matches(t, 'lead', 'i') THEN 'yes' ELSE 'null' END AS arm, count(*) AS n FROM n GROUP BY 1")
def pred4_null_regex(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("platform") == "lever", F.lit(None)).otherwise(F.col("title"))
    hit = gate.matches(F.col("t"), ["lead"])
    return postings(spark, d, "platform", "title").select(t.alias("t")).groupBy(F.when(~hit, "no").when(hit, "yes").otherwise("null").alias("arm")).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT count(*) AS n FROM postings WHERE regexp_matches(title, '.', 'i') AND NOT regexp_matches(title, '\\bsenior\\b|\\bsr\\b', 'i') AND NOT regexp_matches(company_name, 'insurance', 'i') AND platform <> 'nyc_open_data'")
def pred7_loosened_gate(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, *GATED)
    cfg = {k: v for k, v in gate.loosened(GATE).items() if k != "description_include"}
    return p.where(gate.tier(cfg, p.columns) <= 2).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT id FROM postings WHERE ({TIER_SQL}) = 1 OR (({TIER_SQL}) = 2 AND location_is_nyc IS NULL)")
def pred8_survivors(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, *GATED)
    return p.withColumn("tier", gate.tier(GATE, p.columns)).where("tier = 1 or (tier = 2 and location_is_nyc is null)").select("id")


@query(f"WITH {POSTINGS} SELECT count(*) AS n FROM postings WHERE coalesce(title,'') <> '' AND coalesce(company_name,'') <> '' AND coalesce(description_text,'') <> '' AND coalesce(job_url,'') <> '' AND status = 'open'")
def pred9_complete_rows(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, "title", "company_name", "description_text", "job_url", "status")
    full = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in ("title", "company_name", "description_text", "job_url")])
    return p.where(full & (F.col("status") == "open")).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS}, {FACTS} SELECT f.id FROM facts f JOIN postings p USING (id) WHERE f.remote_policy = 'hybrid' AND f.comp_min >= 50 AND p.title ILIKE '%analyst%'")
def pred10_dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = [F.col("remote_policy") == "hybrid", F.col("comp_min") >= 50, F.col("title").ilike("%analyst%")]
    j = facts(spark, d, "remote_policy", "comp_min").join(postings(spark, d, "title"), "id")
    return j.where(reduce(lambda a, b: a & b, wanted)).select("id")


@query(f"WITH {POSTINGS} SELECT id FROM postings WHERE location_raw ILIKE '%100!% remote%' ESCAPE '!' OR location_raw ILIKE '%new!_york%' ESCAPE '!'")
def pred11_escaped_like(spark: SparkSession, d: str) -> DataFrame:
    loc = F.lower("location_raw")
    return postings(spark, d, "location_raw").where(F.contains(loc, F.lit("100% remote")) | F.contains(loc, F.lit("new_york"))).select("id")


@query(f"WITH {POSTINGS} SELECT coalesce(location_is_remote, false) AS remote, count(*) AS n FROM postings GROUP BY 1")
def pred12_null_as_false(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "location_is_remote").groupBy(F.coalesce("location_is_remote", F.lit(False)).alias("remote")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT count(*) AS n FROM facts WHERE (comp_max IS NULL OR comp_max >= 60000) AND (role_archetype IS NULL OR role_archetype IN ('backend','data')) AND coalesce(remote_policy,'') <> 'onsite'")
def pred13_preferences(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d, "comp_max", "role_archetype", "remote_policy")
    ok = (F.col("comp_max").isNull() | (F.col("comp_max") >= 60000)) & (F.col("role_archetype").isNull() | F.col("role_archetype").isin("backend", "data")) & (F.coalesce("remote_policy", F.lit("")) != "onsite")
    return f.where(ok).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS} SELECT id FROM postings WHERE id NOT IN (SELECT id FROM jobs_app) AND platform IN ('lever','ashby')")
def pred14_not_any(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "platform").where(F.col("platform").isin("lever", "ashby")).join(table(spark, d, "jobs_app").select("id"), "id", "left_anti").select("id")


@query(f"WITH {FACTS} SELECT DISTINCT role_archetype FROM facts WHERE role_archetype IS NOT NULL AND role_archetype NOT IN ('other','pm')")
def pred15_not_in_literals(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "role_archetype").where(F.col("role_archetype").isNotNull() & ~F.col("role_archetype").isin("other", "pm")).select("role_archetype").distinct()


@query("SELECT count(*) FILTER (WHERE m LIKE 'FAILED:%') AS failed, count(*) FILTER (WHERE m NOT LIKE 'FAILED:%') AS fine, count(*) AS all_rows FROM (SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'FAILED:' || l_returnflag ELSE l_returnflag END AS m FROM lineitem)")
def pred16_tombstones(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, F.concat(F.lit("FAILED:"), "l_returnflag")).otherwise(F.col("l_returnflag"))
    x = table(spark, d, "lineitem").select(m.alias("m"))
    return x.agg(F.count_if(F.startswith("m", F.lit("FAILED:"))).alias("failed"), F.count_if(~F.startswith("m", F.lit("FAILED:"))).alias("fine"), F.count("*").alias("all_rows"))


@query("SELECT count(*) FILTER (WHERE facts_version IS NOT NULL AND facts_version <> 3) AS stale, count(*) FILTER (WHERE facts_version IS NULL) AS unversioned FROM eval_labels")
def pred17_version_stale(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("facts_version")
    return table(spark, d, "eval_labels").agg(F.count_if(v.isNotNull() & (v != 3)).alias("stale"), F.count_if(v.isNull()).alias("unversioned"))


@query(f"WITH {POSTINGS}, {FACTS} SELECT p.id FROM postings p LEFT JOIN facts f USING (id) WHERE p.status = 'open' AND p.description_text IS NOT NULL AND ({TIER_SQL.replace('title', 'p.title').replace('company_name', 'p.company_name').replace('(platform', '(p.platform')}) <= 2 AND (f.id IS NULL OR f.facts_version < 3)")
def pred18_eligible(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, *GATED, "status").where("status = 'open' and description_text is not null")
    p = p.where(gate.tier(GATE, p.columns) <= 2)
    return p.join(facts(spark, d, "facts_version").withColumn("has", F.lit(True)), "id", "left").where("has is null or facts_version < 3").select("id")


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'own' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cohort' END, 'default') AS source FROM customer")
def pred19_preference_layers(spark: SparkSession, d: str) -> DataFrame:
    own, cohort = F.when(F.col("c_acctbal") < 0, "own"), F.when(F.col("c_mktsegment") == "BUILDING", "cohort")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(own, cohort, F.lit("default")).alias("source"))


@query(f"WITH {POSTINGS}, {FACTS} SELECT CASE WHEN ({TIER_SQL.replace('title', 'p.title').replace('company_name', 'p.company_name').replace('(platform', '(p.platform')}) > 2 THEN 'gate_rejected' WHEN f.comp_min IS NOT NULL THEN 'surfaced' WHEN f.id IS NOT NULL THEN 'below_floor' ELSE 'excluded' END AS stratum, count(*) AS n FROM postings p LEFT JOIN facts f USING (id) GROUP BY 1")
def pred20_strata(spark: SparkSession, d: str) -> DataFrame:
    p = postings(spark, d, *GATED)
    x = p.withColumn("tier", gate.tier(GATE, p.columns)).join(facts(spark, d, "comp_min").withColumn("has", F.lit(True)), "id", "left")
    s = F.when(F.col("tier") > 2, "gate_rejected").when(F.col("comp_min").isNotNull(), "surfaced").when(F.col("has"), "below_floor").otherwise("excluded")
    return x.groupBy(s.alias("stratum")).agg(F.count("*").alias("n"))


@query(f"WITH {LOG}, e AS (SELECT date_trunc('day', ts) AS batch, event_id, CASE WHEN job_id IS NULL THEN 1 WHEN ev = 'impression' AND value < 1 THEN 2 WHEN ev = 'open' AND value > 99.5 THEN 3 END AS err FROM log) SELECT batch, count(*) AS events, min(err) AS verdict FROM e GROUP BY 1")
def pred21_batch_validation(spark: SparkSession, d: str) -> DataFrame:
    err = F.when(F.col("job_id").isNull(), 1).when((F.col("ev") == "impression") & (F.col("value") < 1), 2).when((F.col("ev") == "open") & (F.col("value") > 99.5), 3)
    return log(spark, d).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("batch")).agg(F.count("*").alias("events"), F.min(err).alias("verdict"))


@query(f"WITH {POSTINGS} SELECT id FROM postings WHERE closed_at IS NOT NULL AND substr(closed_at, 1, 10) < '2026-06-01'")
def pred22_expired(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "closed_at").where(F.substring("closed_at", 1, 10) < "2026-06-01").select("id")


@query("SELECT posting_no, round(length(array_to_string(list_filter(regexp_split_to_array(description_text, '\\s+'), lambda x: regexp_matches(x, '[<>&]')), '')) / (length(description_text) + 1.0), 6) >= 0.01 AS rejected FROM posting_batches WHERE description_text IS NOT NULL")
def pred23_markup_ratio(spark: SparkSession, d: str) -> DataFrame:
    marked = F.filter(F.split("description_text", r"\s+"), lambda x: x.rlike("[<>&]"))
    ratio = F.round(F.length(F.array_join(marked, "")) / (F.length("description_text") + 1.0), 6)
    return table(spark, d, "posting_batches").where("description_text is not null").select("posting_no", (ratio >= 0.01).alias("rejected"))


@query("SELECT company_id, date_diff('second', first_validated_at, TIMESTAMP '2026-06-01') / 3600.0 >= 24 * 200 AS due, coalesce(open_jobs, 0) = 0 AND date_diff('second', first_validated_at, TIMESTAMP '2026-06-01') > 86400 * 300 AS retire FROM companies WHERE first_validated_at IS NOT NULL")
def pred24_due_retire(spark: SparkSession, d: str) -> DataFrame:
    secs = F.expr("timestampdiff(SECOND, first_validated_at, timestamp_ntz'2026-06-01 00:00:00')")
    return table(spark, d, "companies").where("first_validated_at is not null").select("company_id", (secs / 3600.0 >= 24 * 200).alias("due"), ((F.coalesce("open_jobs", F.lit(0)) == 0) & (secs > 86400 * 300)).alias("retire"))


@query(f"WITH {POSTINGS} SELECT unnest(['engineer','astronaut','nurse']) AS pattern, unnest([count(*) FILTER (WHERE regexp_matches(title,'engineer','i')), count(*) FILTER (WHERE regexp_matches(title,'astronaut','i')), count(*) FILTER (WHERE regexp_matches(title,'nurse','i'))]) AS hits FROM postings")
def pred25_dead_patterns(spark: SparkSession, d: str) -> DataFrame:
    return gate.dead_patterns(postings(spark, d, "title"), "title", ["engineer", "astronaut", "nurse"])


@query("SELECT company_id, CASE WHEN company_id % 7 = 0 THEN 'dead' WHEN company_id % 7 IN (1, 2, 3) THEN 'unvalidated' WHEN open_jobs IS NULL THEN 'unvalidated' WHEN open_jobs > 0 THEN 'valid' ELSE 'dead' END AS status FROM companies")
def pred26_liveness(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(x) for x in (404, 403, 429, 503, 200, 200, 200)]), (F.col("company_id") % 7 + 1).cast("int"))
    s = F.when(code == 404, "dead").when(code.isin(403, 429) | (code >= 500), "unvalidated").when(F.col("open_jobs").isNull(), "unvalidated").when(F.col("open_jobs") > 0, "valid").otherwise("dead")
    return table(spark, d, "companies").select("company_id", s.alias("status"))


# joins


@query(f"WITH {POSTINGS}, {FACTS} SELECT f.id, p.platform, f.role_archetype FROM facts f JOIN postings p USING (id)")
def j1_inner(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "role_archetype").join(postings(spark, d, "platform"), "id").select("id", "platform", "role_archetype")


@query(f"WITH {POSTINGS}, {FACTS}, lab AS (SELECT job_id, field, max(round_no) AS rounds FROM eval_labels GROUP BY ALL) SELECT p.id, f.salary, lab.rounds FROM postings p JOIN facts f USING (id) LEFT JOIN lab ON lab.job_id = p.id AND lab.field = 'seniority_level' WHERE coalesce(p.title,'') <> ''")
def j2_app_view(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "eval_labels").where("field = 'seniority_level'").groupBy(F.col("job_id").alias("id")).agg(F.max("round_no").alias("rounds"))
    return postings(spark, d, "title").where("coalesce(title, '') <> ''").join(facts(spark, d, "salary"), "id").join(lab, "id", "left").select("id", "salary", "rounds")


@query(f"WITH {LOG} SELECT c.c_custkey, coalesce(x.opened, false) AS opened, coalesce(x.saved, false) AS saved FROM customer c LEFT JOIN LATERAL (SELECT bool_or(ev = 'open') AS opened, bool_or(ev = 'save') AS saved FROM log WHERE user_id = c.c_custkey) x ON true")
def j3_lateral_seen(spark: SparkSession, d: str) -> DataFrame:
    seen = log(spark, d).groupBy(F.col("user_id").alias("c_custkey")).agg(F.bool_or(F.col("ev") == "open").alias("opened"), F.bool_or(F.col("ev") == "save").alias("saved"))
    return table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left").na.fill(False, ["opened", "saved"])


@query("SELECT c.c_custkey, count(o.o_orderkey) > 0 AS member FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY 1")
def j4_filtered_left(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("m", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("m").isNotNull().alias("member"))


@query(f"WITH {LOG} SELECT p.p_partkey, m.n FROM part p LEFT JOIN (SELECT job_id, count(*) AS n FROM log WHERE user_id = 7 GROUP BY 1) m ON m.job_id = p.p_partkey")
def j5_bound_constant(spark: SparkSession, d: str) -> DataFrame:
    mine = log(spark, d).where("user_id = 7").groupBy(F.col("job_id").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").select("p_partkey").join(mine, "p_partkey", "left")


@query(f"WITH {LOG} SELECT i.event_id FROM log i WHERE ev = 'impression' AND NOT EXISTS (SELECT 1 FROM log o WHERE o.user_id = i.user_id AND o.job_id = i.job_id AND o.ev <> 'impression' AND o.ts > i.ts)")
def j6_anti_exists(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    later = e.where("ev <> 'impression'").groupBy("user_id", "job_id").agg(F.max("ts").alias("last"))
    return e.where("ev = 'impression'").join(later, ["user_id", "job_id"], "left").where("last is null or last <= ts").select("event_id")


@query(f"WITH {POSTINGS} SELECT p.id FROM postings p LEFT JOIN jobs_app f ON f.id = p.id WHERE f.id IS NULL")
def j7_anti_left_null(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "status").join(table(spark, d, "jobs_app").select("id"), "id", "left_anti").select("id")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def j8_not_in(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey").join(s, "n_nationkey", "left_anti")


@query("SELECT DISTINCT a.job_id, a.labeller_id FROM eval_labels a WHERE round_no = 1 AND EXISTS (SELECT 1 FROM eval_labels b WHERE b.job_id = a.job_id AND b.field = a.field AND b.labeller_id = a.labeller_id AND b.round_no = 2 AND b.labelled_at >= a.labelled_at + INTERVAL 7 DAY)")
def j9_semi_exists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels").select("job_id", "field", "labeller_id", "round_no", "labelled_at")
    two = e.where("round_no = 2").groupBy("job_id", "field", "labeller_id").agg(F.max("labelled_at").alias("last"))
    return e.where("round_no = 1").join(two, ["job_id", "field", "labeller_id"]).where(F.expr("last >= labelled_at + interval 7 days")).select("job_id", "labeller_id").distinct()


@query(f"WITH {POSTINGS}, {FACTS}, todo AS (SELECT p.id, p.first_seen FROM postings p WHERE p.description_text IS NULL ORDER BY p.last_seen DESC, p.id LIMIT 50) SELECT t.id, coalesce(f.salary, 'none') AS detail FROM todo t LEFT JOIN facts f USING (id)")
def j10_budgeted_merge(spark: SparkSession, d: str) -> DataFrame:
    todo = postings(spark, d, "description_text", "last_seen").where("description_text is null").orderBy(F.desc("last_seen"), "id").limit(50).select("id")
    return todo.join(facts(spark, d, "salary"), "id", "left").select("id", F.coalesce("salary", F.lit("none")).alias("detail"))


@query(f"WITH {LOG} SELECT count(*) AS n FROM log i WHERE ev = 'impression' AND NOT EXISTS (SELECT 1 FROM log o WHERE o.user_id = i.user_id AND o.job_id = i.job_id AND o.ev <> 'impression' AND date_trunc('day', o.ts) = date_trunc('day', i.ts))")
def j11_self_anti(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).select("user_id", "job_id", "ev", F.date_trunc("day", "ts").alias("day"))
    return e.where("ev = 'impression'").join(e.where("ev <> 'impression'"), ["user_id", "job_id", "day"], "left_anti").agg(F.count("*").alias("n"))


@query(f"WITH {LOG}, a AS (SELECT user_id, count(*) AS events FROM log WHERE ev = 'save' GROUP BY 1), b AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal > 5000) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(events, 0) AS events, b.user_id IS NOT NULL AS known FROM a FULL JOIN b ON a.user_id = b.user_id")
def j12_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = log(spark, d).where("ev = 'save'").groupBy("user_id").agg(F.count("*").alias("events"))
    b = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("k"))
    return a.join(b, "user_id", "full_outer").select("user_id", F.coalesce("events", F.lit(0)).alias("events"), F.col("k").isNotNull().alias("known"))


@query(f"WITH {POSTINGS}, {FACTS} SELECT p.id, p.platform, f.remote_policy, l.n AS labels FROM postings p LEFT JOIN facts f USING (id) LEFT JOIN (SELECT job_id, count(*) AS n FROM eval_labels GROUP BY 1) l ON l.job_id = p.id")
def j13_lookup_merge(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "eval_labels").groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("labels"))
    return postings(spark, d, "platform").join(facts(spark, d, "remote_policy"), "id", "left").join(lab, "id", "left")


@query("SELECT l_orderkey, l_linenumber, (SELECT o_totalprice FROM orders WHERE o_orderkey = l_orderkey) AS at_event FROM lineitem WHERE l_quantity > 45")
def j14_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("at_event"))
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")


@query(f"WITH {LOG} SELECT count(*) AS offered, count(*) FILTER (WHERE job_id IN (SELECT job_id FROM log WHERE ev = 'save' AND value > 20)) AS kept FROM log")
def j15_membership(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    known = e.where("ev = 'save' and value > 20").select("job_id").distinct().withColumn("k", F.lit(True))
    return e.join(known, "job_id", "left").agg(F.count("*").alias("offered"), F.count("k").alias("kept"))


@query(f"WITH {POSTINGS}, {FACTS} SELECT e.id AS label_id, p.platform, f.seniority_level FROM eval_labels e JOIN postings p ON p.id = e.job_id LEFT JOIN facts f ON f.id = e.job_id WHERE e.label_set = 'set-00-1' AND e.value IS NOT NULL")
def j16_label_context(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels").where("label_set = 'set-00-1' and value is not null").select(F.col("id").alias("label_id"), F.col("job_id").alias("id"))
    return e.join(postings(spark, d, "platform"), "id").join(facts(spark, d, "seniority_level"), "id", "left").select("label_id", "platform", "seniority_level")


@query("SELECT n.n_name, coalesce(x.customers, 0) AS customers, coalesce(x.rich, 0) AS rich FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS customers, count(*) FILTER (WHERE c_acctbal > 5000) AS rich FROM customer GROUP BY 1) x ON x.c_nationkey = n.n_nationkey")
def j17_lateral_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    return table(spark, d, "nation").join(x, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("rich", F.lit(0)).alias("rich"))


@query("SELECT a.o_custkey, round(abs(a.v - b.v), 2) AS apart FROM (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b USING (o_custkey)")
def j18_profile_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '5-LOW')").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("a"), F.sum(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))).alias("b"))
    return o.where("a is not null and b is not null").select("o_custkey", F.round(F.abs(F.col("a") - F.col("b")), 2).alias("apart"))


@query("SELECT ref_id, unnest(string_split(alt_names, '|')) AS alt FROM canonical_values WHERE alt_names IS NOT NULL")
def j19_cross_lateral(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_values").where("alt_names is not null").select("ref_id", F.explode(F.split("alt_names", r"\|")).alias("alt"))


# aggregates


@query(f"WITH {POSTINGS} SELECT platform, count(*) AS n FROM postings GROUP BY 1")
def a1_group_count(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "platform").groupBy("platform").agg(F.count("*").alias("n"))


@query("SELECT l_shipdate::DATE AS day, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS qty_a, min(l_shipdate) AS first_at, max(l_discount) AS most FROM lineitem GROUP BY 1")
def a2_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))), F.lit(0.0)).alias("qty_a"), F.min("l_shipdate").alias("first_at"), F.max("l_discount").alias("most"))


_FOLD = f"WITH {LOG}, last AS (SELECT user_id, job_id, arg_max(ev, (ts, event_id)) AS ev FROM log WHERE ev IN ('save','unsave') GROUP BY 1, 2)"


def _saved(spark: SparkSession, d: str) -> DataFrame:
    return folds.latest_by(log(spark, d).where("ev in ('save', 'unsave')"), ["user_id", "job_id"], ["ts", "event_id"], ["ev"]).where("ev = 'save'")


@query(_FOLD + " SELECT job_id, count(DISTINCT user_id) AS savers FROM last WHERE ev = 'save' GROUP BY 1 HAVING count(DISTINCT user_id) >= 3")
def a3_latest_fold(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d).groupBy("job_id").agg(F.count("*").alias("savers")).where("savers >= 3")


@query(_FOLD + " SELECT count(DISTINCT user_id) AS savers FROM last WHERE ev = 'save'")
def a4_active_savers(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d).agg(F.countDistinct("user_id").alias("savers"))


@query("SELECT o_orderdate::DATE AS day, count(DISTINCT o_custkey) AS watchers FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 4")
def a5_distinct_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.countDistinct("o_custkey").alias("watchers")).where("watchers >= 4")


@query(_FOLD + " , n AS (SELECT job_id, count(*) AS c FROM last WHERE ev = 'save' GROUP BY 1) SELECT job_id, CASE WHEN c < 3 THEN NULL WHEN c <= 5 THEN '3-5' WHEN c <= 10 THEN '6-10' ELSE '10+' END AS save_bucket, CASE WHEN c < 4 THEN NULL WHEN c <= 6 THEN '4-6' WHEN c <= 10 THEN '7-10' ELSE '11+' END AS watch_bucket FROM n")
def a6_privacy_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = _saved(spark, d).groupBy("job_id").agg(F.count("*").alias("c"))
    return n.select("job_id", folds.saver_bucket(F.col("c")).alias("save_bucket"), folds.watcher_bucket(F.col("c")).alias("watch_bucket"))


@query("SELECT label_set, count(*) FILTER (WHERE facts_version IS NULL) AS unversioned, count(*) FILTER (WHERE facts_version IS NOT NULL AND value IS NULL) AS blank, count(*) FILTER (WHERE facts_version < 3 AND value IS NOT NULL) AS old, count(*) FILTER (WHERE facts_version >= 3 AND value IS NOT NULL) AS current, count(*) AS total FROM eval_labels GROUP BY 1")
def a7_census(spark: SparkSession, d: str) -> DataFrame:
    v, has = F.col("facts_version"), F.col("value").isNotNull()
    return table(spark, d, "eval_labels").groupBy("label_set").agg(F.count_if(v.isNull()).alias("unversioned"), F.count_if(v.isNotNull() & ~has).alias("blank"), F.count_if((v < 3) & has).alias("old"), F.count_if((v >= 3) & has).alias("current"), F.count("*").alias("total"))


@query("SELECT status, n, total, n::DOUBLE / total AS share FROM (SELECT status, count(*) AS n, sum(count(*)) OVER () AS total FROM companies GROUP BY 1)")
def a8_reconciled(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "companies").groupBy("status").agg(F.count("*").alias("n"))
    g = g.crossJoin(F.broadcast(table(spark, d, "companies").agg(F.count("*").alias("total"))))
    return g.select("status", "n", "total", (F.col("n") / F.col("total")).alias("share"))


@query("SELECT ats, count(*) AS boards, count(*) FILTER (WHERE open_jobs IS NULL) AS unknown, CASE WHEN count(*) < 3 THEN 'thin' WHEN count(*) FILTER (WHERE open_jobs IS NULL)::DOUBLE / nullif(count(*), 0) >= 0.4 THEN 'mostly_empty' ELSE 'ok' END AS finding FROM companies GROUP BY 1")
def a9_findings(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "companies").groupBy("ats").agg(F.count("*").alias("boards"), F.count_if(F.col("open_jobs").isNull()).alias("unknown"))
    return g.withColumn("finding", F.when(F.col("boards") < 3, "thin").when(F.try_divide("unknown", "boards") >= 0.4, "mostly_empty").otherwise("ok"))


@query(f"WITH {LOG} SELECT user_id, bool_or(ev = 'save') AS saved, bool_and(value > 1) AS high FROM log GROUP BY 1")
def a10_bool_or(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("user_id").agg(F.bool_or(F.col("ev") == "save").alias("saved"), F.bool_and(F.col("value") > 1).alias("high"))


@query("SELECT job_id, max(CASE WHEN field = 'seniority_level' THEN lower(trim(value)) END) AS seniority_level, max(CASE WHEN field = 'remote_policy' THEN lower(trim(value)) END) AS remote_policy FROM eval_labels GROUP BY 1")
def a11_pivot_max(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_labels").select("job_id", "field", F.lower(F.trim("value")).alias("v"))
    return e.groupBy("job_id").pivot("field", ["seniority_level", "remote_policy"]).agg(F.max("v"))


@query("SELECT DISTINCT field, lower(trim(value)) AS value FROM eval_labels WHERE value IS NOT NULL")
def a12_distinct_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_labels").where("value is not null").select("field", F.lower(F.trim("value")).alias("value")).distinct().orderBy("field", "value")


@query(f"WITH {LOG}, c AS (SELECT job_id, ev, count(*) AS n, min(event_id) AS p FROM log GROUP BY 1, 2) SELECT job_id, arg_max(ev, (n, -p)) AS mode FROM c GROUP BY 1")
def a13_first_mode(spark: SparkSession, d: str) -> DataFrame:
    return folds.first_mode(log(spark, d), ["job_id"], "ev", "event_id")


@query(f"WITH {LOG}, c AS (SELECT user_id, ev, count(*) AS n FROM log GROUP BY 1, 2), t AS (SELECT user_id, ev, n, max(n) OVER (PARTITION BY user_id) AS m FROM c) SELECT user_id, CASE WHEN count(*) = 1 THEN max(ev) END AS mode FROM t WHERE n = m GROUP BY 1")
def a13_consensus_mode(spark: SparkSession, d: str) -> DataFrame:
    return folds.only_mode(log(spark, d), ["user_id"], "ev")


@query(f"WITH {LOG}, k AS (SELECT user_id, CASE WHEN value > 6 THEN round(value)::BIGINT END AS v FROM log), s AS (SELECT user_id, count(*) AS n, count(v) AS k, list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS a FROM k GROUP BY 1) SELECT user_id, CASE WHEN k * 2 > n THEN a[((k - 1) // 2 + 1)::INT] END AS median FROM s")
def a14_lower_median(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("value") > 6, F.round("value").cast("bigint"))
    return log(spark, d).select("user_id", v.alias("v")).groupBy("user_id").agg(folds.lower_median(F.col("v")).alias("median"))


@query("SELECT label_set, count(DISTINCT job_id) AS jobs, count(DISTINCT (job_id, field)) AS items, count(DISTINCT labeller_id) AS people FROM eval_labels GROUP BY 1")
def a16_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_labels").groupBy("label_set").agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct("job_id", "field").alias("items"), F.countDistinct("labeller_id").alias("people"))


@query("SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND l_shipdate < TIMESTAMP '1998-01-01') AS in_window, count(*) AS runs FROM lineitem GROUP BY 1")
def a18_trailing_window(spark: SparkSession, d: str) -> DataFrame:
    ok = F.expr("l_shipdate >= timestamp_ntz'1998-01-01' - interval 90 days and l_shipdate < timestamp_ntz'1998-01-01'")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(ok, F.col("l_quantity"))).alias("in_window"), F.count("*").alias("runs"))


@query("SELECT m.source, count(d.doc_id) AS docs, CASE WHEN count(d.doc_id) = 0 THEN 'no_history' WHEN count(d.doc_id) < 100 * m.target_share THEN 'below' ELSE 'ok' END AS finding FROM mix_targets m LEFT JOIN documents d USING (source) GROUP BY m.source, m.target_share")
def a19_floor_check(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy("source").agg(F.count("doc_id").alias("docs"))
    x = table(spark, d, "mix_targets").select("source", "target_share").join(n, "source", "left").na.fill(0, ["docs"])
    return x.select("source", "docs", F.when(F.col("docs") == 0, "no_history").when(F.col("docs") < 100 * F.col("target_share"), "below").otherwise("ok").alias("finding"))


@query("WITH c AS (SELECT coalesce(lang, '-') AS lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, lang) AS rn FROM c) SELECT CASE WHEN rn <= 4 THEN lang ELSE '... more' END AS lang, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def a20_top_and_more(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "lang")))
    return r.groupBy(F.when(F.col("rn") <= 4, F.col("lang")).otherwise("... more").alias("lang")).agg(F.sum("n").alias("n"))


@query(f"WITH {LOG} SELECT job_id, count(DISTINCT user_id) AS users, count(*) AS n FROM log WHERE ev = 'dismiss' GROUP BY 1")
def a21_dismissals(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where("ev = 'dismiss'").groupBy("job_id").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n")).orderBy(F.desc("users"), "job_id")


@query("SELECT id, min(taken_at) AS first_seen, max(taken_at) AS last_seen, bool_or(status = 'open') AS any_open, max(snapshot_no) AS last_no FROM job_snapshots GROUP BY 1")
def a22_merge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_snapshots").groupBy("id").agg(F.min("taken_at").alias("first_seen"), F.max("taken_at").alias("last_seen"), F.bool_or(F.col("status") == "open").alias("any_open"), F.max("snapshot_no").alias("last_no"))


@query(f"WITH {LOG}, g AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM log) SELECT user_id, count(*) FILTER (WHERE gap <= 36000) AS kept, round(avg(gap) FILTER (WHERE gap <= 36000), 4) AS mean_gap, round(median(gap) FILTER (WHERE gap <= 36000), 4) AS median_gap FROM g GROUP BY 1")
def a23_interval_stats(spark: SparkSession, d: str) -> DataFrame:
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = log(spark, d).withColumn("gap", secs - F.lag(secs).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kept = F.when(F.col("gap") <= 36000, F.col("gap"))
    return e.groupBy("user_id").agg(F.count(kept).alias("kept"), F.round(F.avg(kept), 4).alias("mean_gap"), F.round(F.median(kept), 4).alias("median_gap"))


@query(f"WITH {LOG} SELECT ev, round(count(*) FILTER (WHERE value > 10)::DOUBLE / count(*), 6) AS success, median(value) AS median, max(value) AS most, round(stddev_pop(value), 6) AS spread FROM log GROUP BY 1")
def a24_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("ev").agg(F.round(F.count_if(F.col("value") > 10) / F.count("*"), 6).alias("success"), F.median("value").alias("median"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@query("SELECT platform, count(*) FILTER (WHERE age <= 7) / 7.0 AS week_rate, count(*) FILTER (WHERE age <= 30) / 30.0 AS month_rate FROM (SELECT platform, date_diff('second', arrived_at, TIMESTAMP '2026-06-15') / 86400.0 AS age FROM posting_batches) GROUP BY 1")
def a25_posting_rate(spark: SparkSession, d: str) -> DataFrame:
    age = F.expr("timestampdiff(SECOND, arrived_at, timestamp_ntz'2026-06-15 00:00:00') / 86400.0")
    return table(spark, d, "posting_batches").select("platform", age.alias("age")).groupBy("platform").agg((F.count_if(F.col("age") <= 7) / 7.0).alias("week_rate"), (F.count_if(F.col("age") <= 30) / 30.0).alias("month_rate"))


@query(f"WITH {LOG} SELECT ts::DATE AS day, user_id, count(*) AS claims FROM log WHERE ev = 'open' GROUP BY 1, 2")
def a27_daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where("ev = 'open'").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("claims"))


@query("WITH v AS (SELECT job_id, field, count(value) AS answered, count(DISTINCT lower(trim(value))) AS kinds FROM eval_labels GROUP BY 1, 2) SELECT CASE WHEN answered = 0 THEN 'all_abstained' WHEN kinds = 1 THEN 'agreed' ELSE 'split' END AS outcome, count(*) AS items FROM v GROUP BY 1")
def a28_partition_check(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "eval_labels").groupBy("job_id", "field").agg(F.count("value").alias("answered"), F.countDistinct(F.lower(F.trim("value"))).alias("kinds"))
    return v.groupBy(F.when(F.col("answered") == 0, "all_abstained").when(F.col("kinds") == 1, "agreed").otherwise("split").alias("outcome")).agg(F.count("*").alias("items"))


# set operations


@query("SELECT s_nationkey AS k, 'supplier' AS side FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer WHERE c_acctbal < 0")
def x1_union_all(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side"))
    return s.unionByName(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side")))


@query("SELECT DISTINCT id FROM job_snapshots WHERE snapshot_no = 1 AND id NOT IN (SELECT id FROM job_snapshots WHERE snapshot_no = 2)")
def x3_set_difference(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").select("snapshot_no", "id")
    return s.where("snapshot_no = 1").select("id").distinct().join(s.where("snapshot_no = 2"), "id", "left_anti")


@query("WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM w")
def x4_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    j = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6))
    return table(spark, d, "part").select("p_partkey", j.alias("jaccard"))


@query("WITH w AS (SELECT posting_no, list_filter(string_split(title || ' ' || company_name, ' '), lambda x: x <> '') AS a FROM posting_batches) SELECT posting_no, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ' ') AS words FROM w")
def x5_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.concat("title", F.lit(" "), "company_name"), " "), lambda x: x != "")
    return table(spark, d, "posting_batches").select("posting_no", words.alias("a")).select("posting_no", F.array_join(folds.ordered_distinct(F.col("a")), " ").alias("words"))


@query("SELECT label_set, sha256(string_agg(job_id, chr(10) ORDER BY job_id)) AS digest, count(*) AS members FROM (SELECT DISTINCT label_set, job_id FROM eval_labels) GROUP BY 1")
def x6_set_digest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "eval_labels").select("label_set", "job_id").distinct()
    return s.groupBy("label_set").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("job_id")), "\n"), 256).alias("digest"), F.count("*").alias("members"))
