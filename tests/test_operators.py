"""Semantic traps of the relational operators on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import eventlog, folds, gate, merge, rules, stats, textmine
from lodestar.functions import scalar as S
from lodestar.session import bounded_rows, is_small, materialize
from lodestar.sources import feeds


def test_gate_shapes_and_null_arms(spark):
    assert gate.include_groups(["a", "b"]) == [["a", "b"]] and gate.include_groups([["a"], [], ["b"]]) == [["a"], ["b"]]
    with pytest.raises(ValueError):
        gate.include_groups(["a", ["b"]])
    with pytest.raises(ValueError):
        gate.location_ok(["x; drop"], ["x"])
    df = spark.createDataFrame([("engineer", None, "c", "p"), (None, "python", "c", "p"), ("x", "python", "bad co", "p")], "title string, description_text string, company_name string, platform string")
    cfg = {"title_include": [r"\yengineer\y"], "description_include": ["python"], "title_exclude": ["senior"], "company_exclude": ["bad"]}
    assert [r[0] for r in df.select(gate.tier(cfg, df.columns)).collect()] == [1, 3, 3]  # a null title fails NOT LIKE
    assert [r[0] for r in df.select(gate.union_gate([], df.columns)).collect()] == [False] * 3


def test_reasons_sum_or_stop(spark):
    df = spark.createDataFrame([("mid", "backend", None, True, None), (None, None, None, None, None), ("exec", "backend", None, True, None), ("senior", "admin", "onsite", False, False)], "seniority_level string, role_archetype string, remote_policy string, location_is_nyc boolean, location_is_remote boolean")
    crit = {"base": 50, "seniority": {"target": ["mid"], "tolerate": {"senior": -5}, "hard_exclude": ["exec"], "penalty_per_level": 7, "unknown_penalty": -4}, "archetypes": {"backend": 60, "admin": -100}, "location": {"accept_nyc": True, "neither_penalty": -12, "onsite_elsewhere_penalty": -30}, "unknown_penalty": {"role_archetype": -3, "remote_policy": -2}}
    got = [(r.match_score, [x.rule for x in r.match_reasons]) for r in rules.score(df, crit).collect()]
    assert got[0] == (100, ["base", "archetype:backend"])
    assert got[1] == (29, ["base", "seniority:unknown", "archetype:missing", "location:unmatched", "remote:missing"])
    assert got[2] == (0, ["base", "seniority:exec:excluded"])
    assert got[3] == (0, ["base", "seniority:senior", "archetype:admin"])


def test_every_rule_and_profiles_as_a_table(spark):
    schema = "seniority_level string, years_experience_min int, role_archetype string, ai_involvement string, tech_stack array<string>, remote_policy string, location_is_nyc boolean, location_is_remote boolean, junior_ok boolean"
    rows = [("mid", 9, "backend", "core", ["node.js", "python3"], None, True, None, True), (None, None, None, None, None, None, None, None, None), ("staff", 2, "odd", "avoid", [], "onsite", False, False, False), ("odd", 2, "backend", "odd", [], "remote", None, True, False)]
    crit = {"base": 40, "seniority": {"target": ["mid"], "penalty_per_level": 6}, "years_experience": {"max_required": 3, "over_penalty_per_year": 5, "over_penalty_cap": 20}, "archetypes": {"backend": 10}, "ai_involvement": {"core": 5, "avoid": -100}, "tech": {"boost": {"node": 4, "python": 4}, "cap": 6}, "location": {"accept_nyc": True, "onsite_elsewhere_penalty": -30, "neither_penalty": -10}, "flags": {"junior_ok": 3}, "unknown_penalty": {"years_experience_min": -2, "ai_involvement": -1, "tech_stack": -1, "junior_ok": -1}}
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as profile_no")
    got = [(r.match_score, [(x.rule, x.delta) for x in r.match_reasons]) for r in rules.score(df, crit, ["junior_ok"]).collect()]
    assert got[0] == (44, [("base", 40.0), ("years:9_wanted_vs_3", -20.0), ("archetype:backend", 10.0), ("ai:core", 5.0), ("tech", 6.0), ("flag:junior_ok", 3.0)])
    assert got[1] == (25, [("base", 40.0), ("years:missing", -2.0), ("ai:missing", -1.0), ("tech:missing", -1.0), ("location:unmatched", -10.0), ("flag:junior_ok:missing", -1.0)])
    assert got[2] == (0, [("base", 40.0), ("seniority:staff:2_levels_off", -12.0), ("ai:avoid", -100.0)])
    assert got[3] == (39, [("base", 40.0), ("archetype:backend", 10.0), ("ai:odd:unpriced", -1.0), ("location:unmatched", -10.0)])
    profiles = spark.createDataFrame([("a", json.dumps(crit)), ("b", json.dumps({"base": 7})), ("c", "not json")], "profile string, criteria string")
    by = {}
    for r in rules.score_profiles(df, profiles, ["junior_ok"]).collect():
        by.setdefault(r.profile, []).append(r.match_score)
    assert by == {"a": [g[0] for g in got], "b": [7] * 4, "c": [0] * 4}
    assert rules.score_profiles(df.limit(0), profiles).count() == 0 and rules.score_profiles(df, profiles.limit(0)).count() == 0


def test_latest_fold_is_no_filter(spark):
    df = spark.createDataFrame([(1, 1, 1, "save"), (1, 1, 2, "unsave"), (2, 1, 1, "save")], "u int, j int, t int, ev string")
    got = folds.latest_by(df, ["u", "j"], ["t"], ["ev"]).where("ev = 'save'").collect()
    assert [(r.u, r.j) for r in got] == [(2, 1)]


def test_modes_and_median(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "x", 1)], "k int, v string, p int")
    assert {r.k: r.mode for r in folds.first_mode(df, ["k"], "v", "p").collect()} == {1: "b", 2: "x"}
    assert {r.k: r.mode for r in folds.only_mode(df, ["k"], "v").collect()} == {1: None, 2: "x"}
    m = spark.createDataFrame([(1, 4), (1, 2), (1, 9), (1, 3), (2, 5), (2, None)], "k int, v int")
    assert {r.k: r.m for r in m.groupBy("k").agg(folds.lower_median(F.col("v")).alias("m")).collect()} == {1: 3, 2: None}


def test_average_precision_modes_bracket(spark):
    rows = [(3.0, True), (2.0, False), (2.0, True), (2.0, False), (1.0, True), (None, True)]
    r = stats.average_precision(spark.createDataFrame(rows, "s double, y boolean"), [], "s", "y").collect()[0]
    assert r.positives == 3 and r.pessimistic <= r.expected <= r.optimistic
    # by hand: all three orders of the tied block are equally likely
    want = sum((1 / 1 + 2 / pos + 3 / 5) / 3 for pos in (2, 3, 4)) / 3
    assert math.isclose(r.expected, want)
    none = stats.average_precision(spark.createDataFrame([(1.0, False)], "s double, y boolean"), [], "s", "y").collect()[0]
    assert none.expected is None


def test_wilson_and_verdict(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k int, n int").select(lo.alias("a"), hi.alias("b")).collect()
    assert (r[0].a, r[0].b) == (0.0, 1.0) and math.isclose(r[1].a, 0.236593, abs_tol=1e-6) and math.isclose(r[2].b, 1.0)


def test_bootstrap_is_reproducible(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), F.lit(2.0).alias("b"))
    x, y = (stats.paired_bootstrap(df, "k", "a", "b", draws=200).collect()[0] for _ in range(2))
    assert x == y and x.low < x.mean_delta < x.high and abs(x.mean_delta - (sum(i % 7 for i in range(200)) / 200 - 2)) < 0.2


def test_rolling_dedupe_and_leases(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 50, 100, 101, 250)], "k int, t bigint")
    assert sorted(r.kept for r in eventlog.rolling_kept(df, ["k"], F.col("t"), 100).collect()) == [0, 101, 250]
    q = spark.createDataFrame([(1, 0, 7), (1, 50, 8), (1, 100, 9)], "k int, t bigint, h bigint")
    assert [(r.granted, r.holder) for r in eventlog.leases(q, "k", "t", "h", 100).orderBy("granted").collect()] == [(0, 7), (100, 9)]


def test_skips_are_idempotent(spark):
    rows = [("r", 1, 1, "impression"), ("r", 2, 2, "impression"), ("r", 3, 3, "open"), ("r", 2, 4, "skip")]
    df = spark.createDataFrame(rows, "req string, job_id int, rank int, ev string")
    assert [r.job_id for r in eventlog.derived_skips(df, ["req"], "job_id", "rank", "ev").collect()] == [1]


def test_merge_revives_and_sticky_null(spark):
    stored = spark.createDataFrame([("a", "h", "open", None, "2026-01-01", None), ("b", "h", "closed", "T", "2026-01-01", "x")], "id string, h string, status string, title string, last_seen string, closed_at string").withColumn("first_seen", F.col("last_seen"))
    batch = spark.createDataFrame([("a", "h", "N", "2026-02-02"), ("b", "h", "N", "2026-02-02"), ("c", "h", "N", "2026-02-02")], "id string, h string, title string, last_seen string")
    v = {r.id: r.verdict for r in merge.merge_verdicts(stored, batch, "id", "h", F.col("status") == "open").collect()}
    assert v == {"a": "unchanged", "b": "updated", "c": "new"}
    m = {r.id: r for r in merge.merged(stored, batch, "id", ["title", "h"], sticky=["title"]).collect()}
    assert m["a"].title is None and m["b"].title == "T" and m["b"].status == "open" and m["b"].closed_at is None and m["c"].first_seen == "2026-02-02"
    assert merge.close_missing(stored, stored.limit(0), "id", True, F.lit("now")).where("status = 'open'").count() == 1


def test_cosine_join_loses_no_pair(spark):
    docs = [(i, " ".join(f"t{(i * k) % 17}xx" for k in range(1, 8))) for i in range(60)]
    v = textmine.tfidf(textmine.terms(spark.createDataFrame(docs, "k int, t string"), "k", "t"), "k")
    v = materialize(v)
    vec = {}
    for r in v.collect():
        vec.setdefault(r.k, {})[r.term] = r.w
    want = {(a, b) for a in vec for b in vec if a < b and sum(w * vec[b].get(t, 0) for t, w in vec[a].items()) >= 0.6 + 1e-9}
    got = {(r.a, r.b) for r in textmine.cosine_pairs(v, "k", 0.6).collect()}
    assert want <= got


def test_scalars(spark):
    df = spark.createDataFrame([(" Mid-level ", "https://x.io/a/?utm_source=f&b=2&a=1#top", "<p>A &amp; B</p>", "Ünïcode  C++!"), (None, None, None, None)], "a string, b string, c string, d string")
    r = df.select(S.closed(F.col("a"), S.SENIORITY), S.normalize_url("b"), S.strip_html("c"), S.search_key("d"), S.slugify(F.col("d"))).collect()
    assert tuple(r[0])[:4] == ("mid", "https://x.io/a?a=1&b=2", "A & B", "unicode c++") and r[1][0] is None and r[1][1] == "" and r[1][4] == "unknown"


def test_sources(spark):
    facets = spark.createDataFrame([("s", "a", "x", 60), ("s", "a", "y", 60), ("s", "b", "x", 30), ("s", "b", "y", 30), ("s", "b", "z", 60), ("t", "a", "x", 100)], "board string, facet string, value string, n int")
    totals = spark.createDataFrame([("s", 120), ("t", 100)], "board string, total int")
    assert [tuple(r) for r in feeds.facet_slices(facets, totals, "board", 61).collect()] == [("s", "a", 2)]
    counts = spark.createDataFrame([(100, 98, 104), (80, 98, 104), (None, 1, 2)], "c int, b int, a int")
    assert [r[0] for r in counts.select(feeds.reconciled(F.col("c"), F.col("b"), F.col("a"))).collect()] == [True, False, None]
    pages = spark.createDataFrame([("full", 0, [1, 2]), ("full", 1, [3, 4]), ("full", 2, [5, 6]), ("hole", 0, [1, 2]), ("hole", 2, [5]), ("short", 0, [1]), ("short", 1, [2, 3]), ("none", 0, [])], "board string, page int, rows array<int>")
    got = sorted((r.board, r.page, r.last) for r in feeds.crawl(pages, "board", 2, 2).collect())
    assert got == [("full", 0, False), ("full", 1, False), ("hole", 0, False), ("none", 0, True), ("short", 0, True)]
    page = spark.createDataFrame([(1, '<i data-id="title">lost</i><div data-id="card"><b data-id="company">C</b><i data-id="title">T</i></div>'), (2, None)], "k int, h string")
    assert [tuple(r) for r in feeds.listing_cards(page, "h", "k").collect()] == [(1, "C", "T", 1)]
    ld = spark.createDataFrame([(1, '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[[{"@type":["JobPosting"],"title":"T"}]]}</script>')], "k int, h string")
    assert [r.title for r in feeds.json_ld_postings(ld, "h", "k").collect()] == ["T"]


def test_size_checks(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    with pytest.raises(ValueError):
        bounded_rows(spark.range(11), 10, "x")


def test_crawl_guards_retries_and_config(spark):
    short = spark.createDataFrame([(True,)], "short boolean")
    with pytest.raises(ValueError):
        feeds.complete_or_raise(short)
    calls, waits = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert feeds.with_retries(fetch, wait=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(OSError):
        feeds.with_retries(lambda: (_ for _ in ()).throw(OSError()), max_retries=1)
    assert feeds.without_comments({"_note": 1, "a": [{"_b": 2, "c": 3}]}) == {"a": [{"c": 3}]}


def test_equal_documents_are_compared_once(spark, monkeypatch):
    texts = ["red iron bolt", "iron bolt red", "red iron plate", "old steel nut"]
    docs = [(i, texts[i % 4]) for i in range(40)] + [(None, "red iron bolt")]
    v = textmine.tfidf(textmine.terms(spark.createDataFrame(docs, "k int, t string"), "k", "t"), "k", max_share=0.9).cache()
    kept = {}

    def keep(df, name):
        kept[name] = materialize(df, name)
        return kept[name]

    monkeypatch.setattr(textmine, "materialize", keep)
    monkeypatch.setattr(textmine, "BLOCK", 3)
    for least in (0.2, 0.95):
        got = sorted((r.a, r.b, round(r.sim, 9)) for r in textmine.cosine_pairs(v, "k", least).collect())
        vec = {}
        for r in v.where("k is not null").collect():
            vec.setdefault(r.k, {})[r.term] = r.w
        sims = [(a, b, round(sum(w * vec[b].get(t, 0) for t, w in vec[a].items()), 9)) for a in vec for b in vec if a < b]
        assert got == sorted(x for x in sims if x[2] >= least)
        assert kept["different"].select("g").distinct().count() == 3  # of 40
