"""Additive, explainable rule scoring: every rule a Column over the facts and a criteria struct, reasons kept in order.

Criteria are one struct (``CRITERIA``): given as a mapping it is a literal that the optimiser folds, given as a
table of profiles it is a joined column, so one plan scores every posting for every profile. Nothing leaves the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import is_small

#: Levels from least to most senior; a delta at or below this excludes outright; a cap that is not given. Fixed values.
SENIORITY = ("intern", "new_grad", "junior", "mid", "senior", "staff", "principal", "director", "exec")
HARD_EXCLUDE_AT, NO_CAP = -100, 1_000_000
#: Most profiles scored in one plan; every posting is scored for each of them.
MAX_PROFILES = 10_000

#: What a profile's criteria hold. Parts left out cost nothing.
CRITERIA = (
    "base double, seniority struct<target:array<string>,tolerate:map<string,double>,hard_exclude:array<string>,penalty_per_level:double,unknown_penalty:double>, "
    "years_experience struct<max_required:double,over_penalty_per_year:double,over_penalty_cap:double>, archetypes map<string,double>, ai_involvement map<string,double>, "
    "tech struct<boost:map<string,double>,cap:double>, location struct<accept_nyc:boolean,accept_remote:boolean,onsite_elsewhere_penalty:double,neither_penalty:double>, "
    "flags map<string,double>, unknown_penalty map<string,double>"
)
#: The fact column each rule reads.
FACTS = {"seniority": "seniority_level", "years": "years_experience_min", "archetype": "role_archetype", "ai": "ai_involvement", "tech": "tech_stack", "policy": "remote_policy", "nyc": "location_is_nyc", "remote": "location_is_remote"}

_REASON = "struct<rule:string,delta:double,stops:boolean>"


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _reason(rule: Column | str, delta: Column, may_stop: bool = False) -> Column:
    """A reason, or null where the delta is null or 0 (silent); ``may_stop`` if an excluding delta ends scoring."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    stops = (delta <= HARD_EXCLUDE_AT) if may_stop else F.lit(False)
    return F.when(delta != 0, F.struct(rule.alias("rule"), delta.cast("double").alias("delta"), stops.alias("stops"))).cast(_REASON)


def _has(m: Column, key: Column) -> Column:
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def _priced(value: Column, weights: Column, label: str, missing: Column) -> Column:
    """Weight of a category; a missing or unpriced one costs the unknown penalty and never excludes."""
    name = F.concat(F.lit(f"{label}:"), value)
    known = _reason(name, F.try_element_at(weights, value), True)
    return F.when(value.isNull(), _reason(f"{label}:missing", missing)).when(_has(weights, value), known).otherwise(_reason(F.concat(name, F.lit(":unpriced")), missing))


def seniority_reason(level: Column, cfg: Column, missing: Column) -> Column:
    """Excluded levels end scoring, target levels are silent, tolerated ones have a price, others cost their distance to the nearest target."""
    order = F.array(*[F.lit(x) for x in SENIORITY])
    at = F.array_position(order, level)
    gap = F.array_min(F.transform(F.filter(cfg["target"], lambda t: F.array_contains(order, t)), lambda t: F.abs(F.array_position(order, t) - at)))
    off = F.when(at > 0, _reason(F.concat(F.lit("seniority:"), level, F.lit(":"), gap.cast("string"), F.lit("_levels_off")), -gap * _or0(cfg["penalty_per_level"])))
    tolerated = _reason(F.concat(F.lit("seniority:"), level), F.try_element_at(cfg["tolerate"], level))
    out = F.when(_has(cfg["tolerate"], level), tolerated).otherwise(off)
    out = F.when(F.array_contains(cfg["target"], level), F.lit(None).cast(_REASON)).otherwise(out)
    out = F.when(level.isNull(), _reason("seniority:unknown", F.coalesce(cfg["unknown_penalty"], missing))).otherwise(out)
    excluded = _reason(F.concat(F.lit("seniority:"), level, F.lit(":excluded")), F.lit(float(HARD_EXCLUDE_AT)), True)
    return F.when(F.array_contains(cfg["hard_exclude"], level), excluded).otherwise(out)


def years_reason(required: Column, cfg: Column, missing: Column) -> Column:
    """Each year wanted over the ceiling costs, up to a cap; a figure not stated costs the unknown penalty."""
    over = required - cfg["max_required"]
    penalty = F.least(over * _or0(cfg["over_penalty_per_year"]), F.coalesce(cfg["over_penalty_cap"], F.lit(float(NO_CAP))))
    name = F.concat(F.lit("years:"), required.cast("bigint").cast("string"), F.lit("_wanted_vs_"), cfg["max_required"].cast("bigint").cast("string"))
    return F.when(required.isNull(), _reason("years:missing", missing)).when(over > 0, _reason(name, -penalty))


def tech_reason(stack: Column, cfg: Column, missing: Column) -> Column:
    """Weights of the terms found in the stack, together up to a cap; an empty stack is an answer, a null one is not."""
    earned = F.aggregate(F.map_entries(cfg["boost"]), F.lit(0.0), lambda a, e: a + F.when(F.exists(stack, lambda x: F.contains(x, e["key"])), e["value"]).otherwise(0.0))
    return F.when(stack.isNull(), _reason("tech:missing", missing)).otherwise(_reason("tech", F.when(earned != 0, F.least(earned, F.coalesce(cfg["cap"], F.lit(float(NO_CAP)))))))


def place_reasons(nyc: Column, remote: Column, policy: Column, cfg: Column, missing: Column) -> list[Column]:
    """Outside the accepted places, work on site elsewhere and what cannot be told each have their price."""
    no = F.lit(False)
    accepted = (F.coalesce(cfg["accept_nyc"], no) & F.coalesce(nyc, no)) | (F.coalesce(cfg["accept_remote"], no) & F.coalesce(remote, no))
    elsewhere = F.when(policy.eqNullSafe("onsite"), _reason("location:onsite_elsewhere", cfg["onsite_elsewhere_penalty"])).otherwise(_reason("location:unmatched", cfg["neither_penalty"]))
    return [F.when(~accepted, elsewhere), F.when(~accepted & policy.isNull(), _reason("remote:missing", missing))]


def flag_reason(flag: str, cfg: Column, missing: Column) -> Column:
    """A flag a profile prices: true costs or earns, false is silent, null is missing."""
    c, key = F.col(flag), F.lit(flag)
    return F.when(_has(cfg, key), F.when(c.isNull(), _reason(f"flag:{flag}:missing", missing)).when(c, _reason(f"flag:{flag}", F.try_element_at(cfg, key), True)))


def score(rows: DataFrame, criteria: Mapping | Column, flags: Sequence[str] = (), columns: Mapping[str, str] = FACTS) -> DataFrame:
    """``rows`` with ``match_score`` (0 to 100) and ``match_reasons`` in rule order.

    Scoring stops at the first excluding rule with score 0 and the reasons up to it. ``criteria`` is a mapping or a struct
    column of type ``CRITERIA``; a rule whose fact column ``rows`` does not have is left out; ``flags`` names flag columns.
    """
    c = criteria if isinstance(criteria, Column) else F.from_json(F.lit(json.dumps(criteria)), CRITERIA)
    cols = {k: F.col(v) for k, v in columns.items() if v in rows.columns}

    def miss(fact: str) -> Column:
        return _or0(F.try_element_at(c["unknown_penalty"], F.lit(fact)))

    # a base of 0 is a reason too
    out = [F.struct(F.lit("base").alias("rule"), _or0(c["base"]).alias("delta"), F.lit(False).alias("stops")).cast(_REASON)]
    if "seniority" in cols:
        out.append(seniority_reason(cols["seniority"], c["seniority"], miss("seniority_level")))
    if "years" in cols:
        out.append(years_reason(cols["years"], c["years_experience"], miss("years_experience_min")))
    if "archetype" in cols:
        out.append(_priced(cols["archetype"], c["archetypes"], "archetype", miss("role_archetype")))
    if "ai" in cols:
        out.append(_priced(cols["ai"], c["ai_involvement"], "ai", miss("ai_involvement")))
    if "tech" in cols:
        out.append(tech_reason(cols["tech"], c["tech"], miss("tech_stack")))
    if {"nyc", "remote", "policy"} <= cols.keys():
        out += place_reasons(cols["nyc"], cols["remote"], cols["policy"], c["location"], miss("remote_policy"))
    out += [flag_reason(f, c["flags"], miss(f)) for f in flags]
    x = rows.withColumn("__all", F.array_compact(F.array(*out)))
    x = x.withColumn("__stop", F.expr("array_position(transform(__all, r -> r.stops), true)").cast("int"))
    kept = F.when(F.col("__stop") > 0, F.slice("__all", F.lit(1), F.col("__stop"))).otherwise(F.col("__all"))
    total = F.aggregate("__all", F.lit(0.0), lambda a, r: a + r["delta"])
    value = F.when(F.col("__stop") > 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0)))).cast("int")
    reasons = F.transform(kept, lambda r: F.struct(r["rule"].alias("rule"), r["delta"].alias("delta")))
    return x.withColumn("match_score", value).withColumn("match_reasons", reasons).drop("__all", "__stop")


def score_profiles(rows: DataFrame, profiles: DataFrame, flags: Sequence[str] = (), columns: Mapping[str, str] = FACTS) -> DataFrame:
    """``rows`` scored for each profile of (profile, criteria as JSON): one row per posting and profile, in one narrow plan.

    The profiles, at most ``MAX_PROFILES``, are sent to the tasks; the postings are neither shuffled nor read twice.
    """
    if not is_small(profiles, MAX_PROFILES):
        raise ValueError(f"profiles: more than {MAX_PROFILES}, or criteria too long to send to every task")
    p = profiles.select("profile", F.from_json("criteria", CRITERIA).alias("__criteria"))
    return score(rows.crossJoin(F.broadcast(p)), F.col("__criteria"), flags, columns).drop("__criteria")


def phrases(reasons: Column, limit: int = 3) -> Column:
    """The first positive reasons but the base."""
    return F.slice(F.transform(F.filter(reasons, lambda r: (r["delta"] > 0) & (r["rule"] != "base")), lambda r: r["rule"]), 1, limit)
