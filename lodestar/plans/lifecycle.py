"""Queries of merges, lifecycles and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.operators import eventlog, merge
from lodestar.plans.common import FACTS, JOB_NO_SQL, LOG, POSTINGS, SCORED, facts, job_no, log, postings
from lodestar.plans.windows_stats import scored
from lodestar.session import small_side

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SNAP = "{n} AS (SELECT id, lower(trim(arg_max(content_hash, loaded_at))) AS h, arg_max(status, loaded_at) AS status, arg_max(title, loaded_at) AS title, arg_max(last_seen, loaded_at) AS last_seen, arg_max(closed_at, loaded_at) AS closed_at FROM job_snapshots WHERE snapshot_no = {k} GROUP BY 1)"
_TWO = _SNAP.format(n="stored", k=1) + ", " + _SNAP.format(n="batch", k=2)


def snap(spark: SparkSession, d: str, k: int) -> DataFrame:
    s = table(spark, d, "job_snapshots").where(F.col("snapshot_no") == k)
    x = s.groupBy("id").agg(*[F.max_by(c, "loaded_at").alias(c) for c in ("content_hash", "status", "title", "last_seen", "closed_at")])
    return x.withColumn("h", F.lower(F.trim("content_hash"))).drop("content_hash")


@query(f"WITH {_TWO} SELECT coalesce(s.id, b.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'absent' WHEN s.h IS NOT DISTINCT FROM b.h AND s.status = 'open' THEN 'unchanged' ELSE 'updated' END AS verdict FROM stored s FULL JOIN batch b ON s.id = b.id")
def u1_upsert_verdict(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_verdicts(snap(spark, d, 1), snap(spark, d, 2), "id", "h", F.col("status") == "open")


@query(f"WITH {_TWO} SELECT count(*) AS revived FROM stored s JOIN batch b USING (id) WHERE s.status = 'closed'")
def u2_revived(spark: SparkSession, d: str) -> DataFrame:
    return snap(spark, d, 1).where("status = 'closed'").join(snap(spark, d, 2).select("id"), "id").agg(F.count("*").alias("revived"))


@query(f"WITH {_TWO} SELECT coalesce(s.id, b.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.title ELSE b.title END AS title, CASE WHEN b.id IS NULL THEN s.h ELSE b.h END AS h, CASE WHEN s.id IS NOT NULL THEN s.last_seen ELSE b.last_seen END AS first_seen, CASE WHEN b.id IS NULL THEN s.last_seen ELSE b.last_seen END AS last_seen, CASE WHEN b.id IS NULL THEN s.status ELSE 'open' END AS status, CASE WHEN b.id IS NULL THEN s.closed_at END AS closed_at FROM stored s FULL JOIN batch b ON s.id = b.id")
def u3_sticky_merge(spark: SparkSession, d: str) -> DataFrame:
    stored = snap(spark, d, 1).withColumn("first_seen", F.col("last_seen"))
    return merge.merged(stored, snap(spark, d, 2), "id", ["title", "h"], sticky=["title"])


@query("SELECT batch_no, count(*) AS attempted, count(*) FILTER (WHERE description_text IS NULL) AS errors, count(*) FILTER (WHERE description_text IS NULL)::DOUBLE / count(*) > 0.05 AS abort FROM posting_batches GROUP BY 1")
def u4_error_rate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "posting_batches").groupBy("batch_no").agg(F.count("*").alias("attempted"), F.count_if(F.col("description_text").isNull()).alias("errors"))
    return g.withColumn("abort", merge.error_rate_exceeded(F.col("errors"), F.col("attempted")))


@query(f"WITH {_TWO} SELECT coalesce(s.id, b.id) AS id, coalesce(b.title, s.title) AS title, greatest(coalesce(s.last_seen, ''), coalesce(b.last_seen, '')) AS last_seen FROM stored s FULL JOIN batch b ON s.id = b.id")
def u5_conflict_coalesce(spark: SparkSession, d: str) -> DataFrame:
    s, b = snap(spark, d, 1).select("id", F.col("title").alias("st"), F.col("last_seen").alias("sl")), snap(spark, d, 2).select("id", F.col("title").alias("bt"), F.col("last_seen").alias("bl"))
    return s.join(b, "id", "full_outer").select("id", F.coalesce("bt", "st").alias("title"), F.greatest(F.coalesce("sl", F.lit("")), F.coalesce("bl", F.lit(""))).alias("last_seen"))


@query("WITH n AS (SELECT *, lower(regexp_replace(company_name, '[^A-Za-z]', '', 'g')) AS new_id FROM companies) SELECT new_id, arg_max(company_id, (first_validated_at, company_id)) AS survivor, count(*) AS merged, min(company_id) AS first, max(first_validated_at) AS last FROM n GROUP BY 1")
def u6_rekey_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "companies")
    return merge.rekeyed(c, "company_id", F.lower(F.regexp_replace("company_name", "[^A-Za-z]", "")), ["first_validated_at"], "first_validated_at", "company_id")


@query(f"WITH {_TWO} SELECT s.id, CASE WHEN b.id IS NULL AND s.status = 'open' THEN 'closed' ELSE s.status END AS status FROM stored s LEFT JOIN batch b USING (id)")
def u7_close_missing(spark: SparkSession, d: str) -> DataFrame:
    return merge.close_missing(snap(spark, d, 1), snap(spark, d, 2), "id", True, F.lit("2026-10-12T03:00:00")).select("id", "status")


@query(f"WITH {POSTINGS} SELECT id FROM postings WHERE status = 'open' AND last_seen < '2026-11-01T00:00:00'")
def u8_close_stale(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d, "status", "last_seen").where("status = 'open' and last_seen < '2026-11-01T00:00:00'").select("id")


@query(f"WITH {POSTINGS} SELECT id, CASE WHEN status = 'open' AND last_seen < '2026-11-01T00:00:00' THEN substr(last_seen, 1, 10) ELSE substr(closed_at, 1, 10) END AS closed_on FROM postings")
def u9_close_expired(spark: SparkSession, d: str) -> DataFrame:
    stale = (F.col("status") == "open") & (F.col("last_seen") < "2026-11-01T00:00:00")
    return postings(spark, d, "status", "last_seen", "closed_at").select("id", F.when(stale, F.substring("last_seen", 1, 10)).otherwise(F.substring("closed_at", 1, 10)).alias("closed_on"))


@query(f"WITH {POSTINGS}, old AS (SELECT id FROM postings WHERE status = 'closed' AND closed_at < '2026-09-01') SELECT count(*) AS children FROM eval_labels WHERE job_id NOT IN (SELECT id FROM old)")
def u10_prune_cascade(spark: SparkSession, d: str) -> DataFrame:
    old = postings(spark, d, "status", "closed_at").where("status = 'closed' and closed_at < '2026-09-01'").select(F.col("id").alias("job_id"))
    return table(spark, d, "eval_labels").select("job_id").join(old, "job_id", "left_anti").agg(F.count("*").alias("children"))


@query(f"WITH {POSTINGS} SELECT p.id, CASE WHEN s.id IS NOT NULL THEN '2026-11-20T00:00:00' ELSE p.last_seen END AS last_seen FROM postings p LEFT JOIN (SELECT DISTINCT id FROM job_snapshots WHERE snapshot_no = 7) s USING (id)")
def u11_touch_seen(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").where("snapshot_no = 7").select("id").distinct().withColumn("seen", F.lit(True))
    return postings(spark, d, "last_seen").join(s, "id", "left").select("id", F.when(F.col("seen"), "2026-11-20T00:00:00").otherwise(F.col("last_seen")).alias("last_seen"))


@query("WITH a AS (SELECT DISTINCT platform, id FROM job_snapshots WHERE snapshot_no = 6), b AS (SELECT DISTINCT platform, id FROM job_snapshots WHERE snapshot_no = 7), n AS (SELECT platform, count(*) AS before FROM a GROUP BY 1), m AS (SELECT platform, count(*) AS after FROM b GROUP BY 1) SELECT platform, coalesce(after, 0) AS rows, greatest(0, coalesce(before, 0) - coalesce(after, 0)) AS withdrawn FROM n FULL JOIN m USING (platform)")
def u12_snapshot_replace(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").where("snapshot_no in (6, 7)").select("platform", "id", "snapshot_no").distinct()
    g = s.groupBy("platform").agg(F.count_if(F.col("snapshot_no") == 6).alias("before"), F.count_if(F.col("snapshot_no") == 7).alias("rows"))
    return g.select("platform", "rows", F.greatest(F.lit(0).cast("bigint"), F.col("before") - F.col("rows")).alias("withdrawn"))


@query(f"WITH {SCORED}, f AS (SELECT s.id, s.match_score, c.facts_version AS v FROM scored s JOIN facts c USING (id)), st AS (SELECT job_id AS id, max(facts_version) AS v FROM eval_labels GROUP BY 1) SELECT coalesce(f.id, st.id) AS id, CASE WHEN f.id IS NULL THEN 'prune' WHEN st.id IS NOT NULL AND f.v IS NOT DISTINCT FROM st.v THEN 'skip' WHEN f.match_score >= 40 THEN 'write' WHEN st.id IS NOT NULL THEN 'demote' ELSE 'ignore' END AS action FROM f FULL JOIN st ON f.id = st.id")
def u13_incremental(spark: SparkSession, d: str) -> DataFrame:
    f = scored(spark, d).select("id", "match_score").join(facts(spark, d, "facts_version"), "id")
    st = table(spark, d, "eval_labels").groupBy(F.col("job_id").alias("id")).agg(F.max("facts_version").alias("facts_version"))
    return merge.recompute_verdicts(f, st, "id", ["facts_version"], F.col("match_score"), 40)


@query(f"WITH {FACTS} SELECT DISTINCT job_id FROM eval_labels WHERE job_id NOT IN (SELECT id FROM facts)")
def u14_orphans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_labels").select("job_id").distinct().join(facts(spark, d, "platform").select(F.col("id").alias("job_id")), "job_id", "left_anti")


@query(f"WITH {FACTS} SELECT id, CASE WHEN salary = 'DOE' THEN NULL ELSE role_archetype END AS role_archetype, CASE WHEN salary = 'DOE' THEN 'FAILED:v' || facts_version END AS label, facts_version FROM facts")
def u16_tombstone_write(spark: SparkSession, d: str) -> DataFrame:
    bad = F.coalesce(F.col("salary") == "DOE", F.lit(False))
    return facts(spark, d, "salary", "role_archetype", "facts_version").select("id", F.when(~bad, F.col("role_archetype")).alias("role_archetype"), F.when(bad, F.concat(F.lit("FAILED:v"), "facts_version")).alias("label"), "facts_version")


@query(f"WITH {LOG} SELECT user_id, count(*) AS runs, max(ts) AS last_run_at, max(ts) FILTER (WHERE value > 5) AS last_result_at FROM log GROUP BY 1")
def u17_run_record(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("ts").alias("last_run_at"), F.max(F.when(F.col("value") > 5, F.col("ts"))).alias("last_result_at"))


@query(f"WITH {LOG}, m AS (SELECT user_id, max(ts) AS mark FROM log WHERE ev = 'save' GROUP BY 1), x AS (SELECT DISTINCT l.user_id, l.ts, l.value FROM log l LEFT JOIN m USING (user_id) WHERE mark IS NULL OR l.ts > mark) SELECT user_id, count(*) AS runs, max(ts) AS last_run_at, round(arg_max(value, ts), 6) AS last_value FROM x GROUP BY 1")
def u18_reconcile_runs(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    mark = e.where("ev = 'save'").groupBy("user_id").agg(F.max("ts").alias("mark"))
    x = e.join(mark, "user_id", "left").where("mark is null or ts > mark").select("user_id", "ts", "value").distinct()
    return x.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("ts").alias("last_run_at"), F.round(F.max_by("value", "ts"), 6).alias("last_value"))


@query(f"WITH {LOG} SELECT job_id, max(ts) < TIMESTAMP '2024-01-29' AS retired FROM log WHERE ev = 'open' GROUP BY 1")
def u19_decay(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).where("ev = 'open'").groupBy("job_id").agg((F.max("ts") < F.expr("timestamp_ntz'2024-01-29 00:00:00'")).alias("retired"))


@query(f"WITH {LOG} SELECT user_id, job_id, arg_max(ev, (ts, event_id)) = 'unsave' AS removed FROM log WHERE ev IN ('save','unsave') GROUP BY 1, 2")
def u20_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).where("ev in ('save', 'unsave')")
    return e.groupBy("user_id", "job_id").agg((F.max_by("ev", F.struct("ts", "event_id")) == "unsave").alias("removed"))


@query("SELECT n_nationkey, coalesce(v.r, n_regionkey) AS n_regionkey FROM nation n LEFT JOIN (SELECT unnest([1, 3, 5]) AS k, unnest([9, 8, 7]) AS r) v ON v.k = n.n_nationkey")
def u21_bulk_update(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(1, 9), (3, 8), (5, 7)], "n_nationkey int, r int")
    return table(spark, d, "nation").join(F.broadcast(v), "n_nationkey", "left").select("n_nationkey", F.coalesce("r", "n_regionkey").alias("n_regionkey"))


@query("SELECT platform, count(*) AS rows, count(*) FILTER (WHERE sha256(coalesce(description_text, '')) <> content_hash) AS differs FROM posting_batches GROUP BY 1")
def u22_rederive(spark: SparkSession, d: str) -> DataFrame:
    made = F.sha2(F.coalesce("description_text", F.lit("")), 256)
    return table(spark, d, "posting_batches").groupBy("platform").agg(F.count("*").alias("rows"), F.count_if(made != F.col("content_hash")).alias("differs"))


# event log

_KEPT = f"""{LOG}, seen AS (SELECT user_id, job_id, list_sort(list(CAST(floor(epoch(ts)) AS BIGINT))) AS a FROM log WHERE ev = 'impression' GROUP BY 1, 2)"""


@query(f"WITH {SCORED}, {LOG}, m AS (SELECT {JOB_NO_SQL} AS job_id, arg_min(match_score, id) AS match_score FROM scored GROUP BY 1) SELECT l.event_id, m.match_score FROM log l LEFT JOIN m USING (job_id)")
def t1_stamped_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the score its posting had; null where there is no such posting."""
    m = scored(spark, d).select("id", "match_score").groupBy(job_no(F.col("id")).alias("job_id")).agg(F.min_by("match_score", "id").alias("match_score"))
    return log(spark, d).select("event_id", "job_id").join(small_side(m), "job_id", "left").select("event_id", "match_score")


@query(f"WITH {_KEPT}, g AS (SELECT user_id, job_id, list_reduce(list_prepend([]::BIGINT[], list_transform(a, lambda x: [x])), lambda k, x: CASE WHEN len(k) = 0 OR k[-1] < x[1] - 86400 THEN list_concat(k, x) ELSE k END) AS kept FROM seen) SELECT user_id, job_id, unnest(kept) AS kept FROM g")
def t2_rolling_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).where("ev = 'impression'").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return eventlog.rolling_kept(e, ["user_id", "job_id"], F.col("s"), 86400)


_RENDER = f"{LOG}, r AS (SELECT *, date_trunc('day', ts) AS day FROM log), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS rank FROM r)"


def ranked_log(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")))


@query(f"WITH {_RENDER}, o AS (SELECT user_id, day, max(rank) AS lowest FROM k WHERE ev = 'open' GROUP BY 1, 2) SELECT k.event_id FROM k JOIN o USING (user_id, day) WHERE k.ev = 'impression' AND k.rank < lowest AND NOT EXISTS (SELECT 1 FROM k x WHERE x.user_id = k.user_id AND x.day = k.day AND x.job_id = k.job_id AND x.ev <> 'impression')")
def t3_derived_skips(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.derived_skips(ranked_log(spark, d), ["user_id", "day"], "job_id", "rank", "ev").select("event_id")


@query(f"WITH {LOG}, s AS (SELECT user_id, job_id, arg_max((ev, ts), (ts, event_id)) AS x FROM log WHERE ev IN ('save','unsave') GROUP BY 1, 2), m AS (SELECT user_id, job_id, max(ts) AS at FROM log WHERE ev = 'dismiss' GROUP BY 1, 2), k AS (SELECT DISTINCT user_id, job_id FROM log) SELECT k.user_id, k.job_id, CASE WHEN s.x[1] = 'save' THEN s.x[2] END AS saved_at, m.at AS dismissed_at FROM k LEFT JOIN s USING (user_id, job_id) LEFT JOIN m USING (user_id, job_id)")
def t4_state_fold(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.state_fold(log(spark, d), ["user_id", "job_id"], "ev", "ts", "event_id")


@query(f"WITH {LOG} SELECT CASE WHEN ev = 'save' THEN 'cohort_anon' ELSE 'private' END AS visibility, count(*) AS n FROM log GROUP BY 1")
def t5_visibility(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(eventlog.visibility(F.col("ev")).alias("visibility")).agg(F.count("*").alias("n"))


@query(f"WITH {_RENDER} SELECT event_id, user_id || ':' || strftime(day, '%Y-%m-%d') AS request_id, rank FROM k")
def t6_render_attribution(spark: SparkSession, d: str) -> DataFrame:
    return ranked_log(spark, d).select("event_id", F.concat_ws(":", "user_id", F.date_format("day", "yyyy-MM-dd")).alias("request_id"), "rank")


@query(f"WITH {LOG} SELECT job_id AS dataset, max(ts) FILTER (WHERE ev = 'open') AS watermark FROM log GROUP BY 1")
def t8_watermark(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy(F.col("job_id").alias("dataset")).agg(F.max(F.when(F.col("ev") == "open", F.col("ts"))).alias("watermark"))


_LEASE = f"""{LOG}, a AS (SELECT job_id, list_sort(list((CAST(floor(epoch(ts)) AS BIGINT) * 1000000 + user_id))) AS a FROM log WHERE ev = 'open' GROUP BY 1),
g AS (SELECT job_id, list_reduce(list_prepend([]::BIGINT[], list_transform(a, lambda x: [x])), lambda k, x: CASE WHEN len(k) = 0 OR k[-1] // 1000000 <= x[1] // 1000000 - 3600 THEN list_concat(k, x) ELSE k END) AS g FROM a), grants AS (SELECT job_id, unnest(g) AS v FROM g)"""


@query(f"WITH {_LEASE} SELECT job_id, v // 1000000 AS granted, v % 1000000 AS holder FROM grants")
def t9_leases(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d).where("ev = 'open'").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return eventlog.leases(e, "job_id", "s", "user_id", 3600)


@query(f"WITH {_LEASE}, h AS (SELECT job_id, max(v) AS v FROM grants GROUP BY 1) SELECT job_id, v % 1000000 AS holder, v // 1000000 + 3600 > epoch(TIMESTAMP '2024-01-30 12:00:00') AS holds FROM h")
def t10_holder(spark: SparkSession, d: str) -> DataFrame:
    g = t9_leases(spark, d).groupBy("job_id").agg(F.max(F.struct("granted", "holder")).alias("g"))
    return g.select("job_id", F.col("g.holder").alias("holder"), (F.col("g.granted") + 3600 > 1706616000).alias("holds"))


@query(f"WITH {LOG} SELECT user_id, CASE WHEN max(value) FILTER (WHERE ev = 'save') IS NULL THEN 5 ELSE greatest(0, least(50, CAST(round(max(value) FILTER (WHERE ev = 'save')) AS BIGINT)) - count(*) FILTER (WHERE ev = 'open')) END AS allowance FROM log GROUP BY 1")
def t15_allowance(spark: SparkSession, d: str) -> DataFrame:
    cap, used = F.max(F.when(F.col("ev") == "save", F.col("value"))), F.count_if(F.col("ev") == "open")
    a = F.when(cap.isNull(), 5).otherwise(F.greatest(F.lit(0), F.least(F.lit(50), F.round(cap).cast("bigint")) - used))
    return log(spark, d).groupBy("user_id").agg(a.alias("allowance"))


@query("WITH seen AS (SELECT DISTINCT id FROM job_snapshots WHERE snapshot_no <= 2), new AS (SELECT DISTINCT id, status FROM job_snapshots WHERE snapshot_no = 3) SELECT count(*) AS fresh FROM (SELECT DISTINCT id FROM new WHERE id NOT IN (SELECT id FROM seen))")
def t17_processed_set(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_snapshots").select("id", "snapshot_no")
    return s.where("snapshot_no = 3").select("id").distinct().join(s.where("snapshot_no <= 2"), "id", "left_anti").agg(F.count("*").alias("fresh"))


@query(f"WITH {LOG} SELECT CASE WHEN value > 40 THEN 'deferred' WHEN value > 20 THEN 'tombstone' WHEN value < 0.1 THEN 'refused' ELSE 'done' END AS outcome, count(*) AS n FROM log GROUP BY 1")
def t21_failure_classes(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("value") > 40, "deferred").when(F.col("value") > 20, "tombstone").when(F.col("value") < 0.1, "refused").otherwise("done")
    return log(spark, d).groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT date_trunc('hour', ts) AS hour, ev, count(*) AS n, round(sum(value), 4) AS total FROM log GROUP BY 1, 2")
def t22_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return log(spark, d).groupBy(w.alias("w"), "ev").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "ev", "n", "total")


@query(f"WITH {LOG}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM log), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, s")
def t22_session_window(spark: SparkSession, d: str) -> DataFrame:
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    return log(spark, d).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")
