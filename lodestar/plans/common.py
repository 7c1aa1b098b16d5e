"""Shared bindings of the reference operators to the tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import events, table

#: Which client event each stream event stands for.
EVENT_NAMES = {"view": "impression", "click": "open", "purchase": "save", "signup": "unsave", "error": "dismiss"}


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The engagement log: event_id, ts, user_id, job_id, ev, value."""
    name = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])
    return events(spark, folder).select("event_id", "ts", "user_id", "job_id", F.element_at(name, F.col("event_type")).alias("ev"), "value")


#: The job number by which the log names a posting.
JOB_NO_SQL = "CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 100"


def job_no(id_: Column) -> Column:
    return F.conv(F.substring(F.md5(id_), 1, 8), 16, 10).cast("bigint") % 100


def postings(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct rows of ``jobs`` (deliveries repeat some), pruned to the columns used."""
    t = table(spark, folder, "jobs")
    return (t.select("id", *[c for c in columns if c != "id"]) if columns else t).dropDuplicates(["id"])


def facts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Distinct rows of ``jobs_app``."""
    t = table(spark, folder, "jobs_app")
    return (t.select("id", *[c for c in columns if c != "id"]) if columns else t).dropDuplicates(["id"])


LOG = """log AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, value,
  CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'unsave' WHEN 'error' THEN 'dismiss' END AS ev FROM events)"""
POSTINGS = "postings AS (SELECT DISTINCT ON (id) * FROM jobs)"
FACTS = "facts AS (SELECT DISTINCT ON (id) * FROM jobs_app)"

#: A gate and rule weights for the postings at hand.
GATE = {
    "title_include": [[r"\yengineer\y", r"\ydeveloper\y", r"\yanalyst\y", r"\yscientist\y"]],
    "description_include": [["kubernetes", "python", "postgres"], ["team", "group", "office"]],
    "title_exclude": [r"\ysenior\y", r"\ysr\y"],
    "company_exclude": ["insurance"],
    "platform_exclude": ["nyc_open_data"],
    "location_columns": ["location_is_nyc", "location_is_remote"],
    "max_tier": 2,
}
GATE_B = {"title_include": [r"\ynurse\y", r"\yplanner\y"], "location_columns": ["location_is_remote"], "max_tier": 1}
CRITERIA = {
    "base": 50,
    "seniority": {"target": ["junior", "mid"], "tolerate": {"senior": -5}, "hard_exclude": ["exec"], "penalty_per_level": 7, "unknown_penalty": -4},
    "years_experience": {"max_required": 4, "over_penalty_per_year": 2, "over_penalty_cap": 9},
    "archetypes": {"backend": 20, "data": 15, "frontend": 10, "security": 5, "admin_ops": -100},
    "ai_involvement": {"core": 8, "adjacent": 2, "avoid": -100},
    "tech": {"boost": {"kafka": 4, "docker": 3, "python": 6, "linux": 2}, "cap": 7},
    "location": {"accept_nyc": True, "accept_remote": True, "onsite_elsewhere_penalty": -30, "neither_penalty": -12},
    "flags": {"customer_facing": -6},
    "unknown_penalty": {"role_archetype": -3, "remote_policy": -2, "years_experience_min": -1, "ai_involvement": -2, "tech_stack": -1, "customer_facing": -1},
}
FLAGS = ("customer_facing",)
#: Facts the tables do not hold, worked out of the texts: first figure up to 20, words of the title, tools named.
_TOOLS = "kafka|docker|python|linux|excel|salesforce"


def extracted(rows: DataFrame) -> DataFrame:
    """``rows`` with years_experience_min, ai_involvement, tech_stack and customer_facing."""
    years = F.regexp_extract("description_text", r"([0-9]+)", 1).try_cast("int")
    ai = F.when(F.col("title").rlike("(?i)machine learning|data|research"), "core").when(F.col("title").rlike("(?i)engineer|developer"), "adjacent").when(F.col("title").rlike("(?i)claims"), "avoid").when(F.col("employment_type") != "unknown", "none")
    facing = F.when(F.col("employment_type") != "unknown", F.coalesce(F.col("title").rlike("(?i)account|support|nurse|recruiter"), F.lit(False)))
    return rows.withColumns({"years_experience_min": F.when(years <= 20, years), "ai_involvement": ai, "tech_stack": F.regexp_extract_all(F.lower("description_text"), F.lit(f"({_TOOLS})"), F.lit(1)), "customer_facing": facing})


TIER_SQL = """CASE
  WHEN ((regexp_matches(title, '\\bengineer\\b|\\bdeveloper\\b|\\banalyst\\b|\\bscientist\\b', 'i')
      OR (regexp_matches(coalesce(description_text, ''), 'kubernetes|python|postgres', 'i') AND regexp_matches(coalesce(description_text, ''), 'team|group|office', 'i')))
    AND NOT regexp_matches(title, '\\bsenior\\b|\\bsr\\b', 'i') AND NOT regexp_matches(company_name, 'insurance', 'i') AND NOT regexp_matches(platform, 'nyc_open_data', 'i'))
    AND (coalesce(location_is_nyc, false) OR coalesce(location_is_remote, false)) THEN 1
  WHEN ((regexp_matches(title, '\\bengineer\\b|\\bdeveloper\\b|\\banalyst\\b|\\bscientist\\b', 'i')
      OR (regexp_matches(coalesce(description_text, ''), 'kubernetes|python|postgres', 'i') AND regexp_matches(coalesce(description_text, ''), 'team|group|office', 'i')))
    AND NOT regexp_matches(title, '\\bsenior\\b|\\bsr\\b', 'i') AND NOT regexp_matches(company_name, 'insurance', 'i') AND NOT regexp_matches(platform, 'nyc_open_data', 'i')) THEN 2
  ELSE 3 END"""
#: SQL of the score for CRITERIA, part by part; the parameters in braces are what profiles may differ in.
LEVEL_SQL = """CASE WHEN lvl = 'exec' THEN -100 WHEN lvl IS NULL THEN -4 WHEN lvl IN ('junior', 'mid') THEN 0 WHEN lvl = 'senior' THEN -5
  WHEN lvl = 'intern' THEN -14 WHEN lvl = 'new_grad' THEN -7 WHEN lvl = 'staff' THEN -14 WHEN lvl = 'principal' THEN -21 WHEN lvl = 'director' THEN -28 ELSE 0 END"""
YEARS_SQL = "CASE WHEN years IS NULL THEN -1 WHEN years > {ceiling} THEN -least((years - {ceiling}) * 2, 9) ELSE 0 END"
ROLE_SQL = "CASE role_archetype WHEN 'backend' THEN {backend} WHEN 'data' THEN 15 WHEN 'frontend' THEN 10 WHEN 'security' THEN 5 WHEN 'admin_ops' THEN -100 ELSE -3 END"
AI_SQL = "CASE ai WHEN 'core' THEN 8 WHEN 'adjacent' THEN 2 WHEN 'avoid' THEN -100 ELSE -2 END"
TECH_SQL = "CASE WHEN stack IS NULL THEN -1 ELSE least(4 * list_contains(stack, 'kafka')::INT + 3 * list_contains(stack, 'docker')::INT + 6 * list_contains(stack, 'python')::INT + 2 * list_contains(stack, 'linux')::INT, 7) END"
_OK_SQL = "(coalesce(location_is_nyc, false) OR {remote} AND coalesce(location_is_remote, false))"
PLACE_SQL = f"CASE WHEN {_OK_SQL} THEN 0 WHEN remote_policy = 'onsite' THEN -30 ELSE -12 END"
POLICY_SQL = f"CASE WHEN NOT {_OK_SQL} AND remote_policy IS NULL THEN -2 ELSE 0 END"
FLAG_SQL = "CASE WHEN facing IS NULL THEN -1 WHEN facing THEN -6 ELSE 0 END"
FACT_SQL = f"""base AS (
  SELECT f.id, p.platform, p.title, p.first_seen, f.role_archetype, f.remote_policy, p.location_is_nyc, p.location_is_remote,
         CASE WHEN lower(f.seniority_level) IN ('intern','new_grad','junior','mid','senior','staff','principal','director','exec') THEN lower(f.seniority_level) END AS lvl,
         CASE WHEN TRY_CAST(regexp_extract(p.description_text, '([0-9]+)', 1) AS INT) <= 20 THEN TRY_CAST(regexp_extract(p.description_text, '([0-9]+)', 1) AS INT) END AS years,
         CASE WHEN regexp_matches(p.title, 'machine learning|data|research', 'i') THEN 'core' WHEN regexp_matches(p.title, 'engineer|developer', 'i') THEN 'adjacent' WHEN regexp_matches(p.title, 'claims', 'i') THEN 'avoid' WHEN f.employment_type <> 'unknown' THEN 'none' END AS ai,
         CASE WHEN p.description_text IS NOT NULL THEN regexp_extract_all(lower(p.description_text), '{_TOOLS}') END AS stack,
         CASE WHEN f.employment_type <> 'unknown' THEN coalesce(regexp_matches(p.title, 'account|support|nurse|recruiter', 'i'), false) END AS facing
  FROM facts f JOIN postings p USING (id))"""


def parts_sql(ceiling: str = "4", backend: str = "20", remote: str = "true") -> str:
    """The parts of the score as columns."""
    parts = (("dl", LEVEL_SQL), ("dy", YEARS_SQL), ("dr", ROLE_SQL), ("da", AI_SQL), ("dt", TECH_SQL), ("dp", PLACE_SQL), ("dm", POLICY_SQL), ("df", FLAG_SQL))
    return ", ".join(f"{sql.format(ceiling=ceiling, backend=backend, remote=remote)} AS {name}" for name, sql in parts)


STOPPED_SQL = "dl <= -100 OR dr <= -100 OR da <= -100"
SCORED = f"""{POSTINGS}, {FACTS}, {FACT_SQL},
parts AS (SELECT *, {parts_sql()} FROM base),
scored AS (SELECT *, CASE WHEN {STOPPED_SQL} THEN 0 ELSE greatest(0, least(100, 50 + dl + dy + dr + da + dt + dp + dm + df)) END AS match_score FROM parts)"""
