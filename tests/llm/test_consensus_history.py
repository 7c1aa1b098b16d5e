"""Consensus against a plain EM in Python; repeated postings against brute force."""

import datetime as dt
import itertools
import math
import random
from collections import defaultdict

import numpy as np

from lodestar.llm import consensus as C
from lodestar.llm import history as H

LABELS = "id bigint, job_id string, field string, value string, labeller_id string, round_no int, labelled_at timestamp"
T0 = dt.datetime(2026, 1, 1)


def answers(n_items=40, seed=1):
    rng = random.Random(seed)
    care = {"a": 0.95, "b": 0.9, "c": 0.9, "d": 0.15, "e": 0.15}
    truth, rows = {}, []
    for j in range(n_items):
        truth[f"j{j}"] = rng.choice("xyz")
        for who in rng.sample(sorted(care), 4):
            v = truth[f"j{j}"] if rng.random() < care[who] else rng.choice("xyz")
            rows.append((len(rows), f"j{j}", "f", v, who, 1, T0))
    return truth, rows


def plain_em(rows, rounds):
    votes = defaultdict(dict)
    for _, j, f, v, who, *_ in rows:
        votes[j, f][who] = v
    post = {i: {c: sum(v == c for v in a.values()) / len(a) for c in set(a.values())} for i, a in votes.items()}
    for _ in range(rounds):
        n = defaultdict(float)
        for i, a in votes.items():
            for who, v in a.items():
                for c, p in post[i].items():
                    n[i[1], who, c, v] += p
        fields = {k[0] for k in n}
        label_n = {f: defaultdict(float) for f in fields}
        row_n, tot, right = defaultdict(float), defaultdict(float), defaultdict(float)
        for (f, who, c, v), x in n.items():
            label_n[f][c] += x
            row_n[f, who, c] += x
            tot[who] += x
            right[who] += x * (c == v)
        for i, a in votes.items():
            f = i[1]
            k, total = len(label_n[f]), sum(label_n[f].values())
            s = {}
            for c in post[i]:
                s[c] = math.log((label_n[f][c] + 1) / (total + k))
                for who, v in a.items():
                    acc = (right[who] + C.PRIOR_N * C.PRIOR_ACCURACY) / (tot[who] + C.PRIOR_N)
                    base = acc if c == v else (1 - acc) / max(k - 1, 1)
                    s[c] += math.log((n[f, who, c, v] + C.SMOOTHING * base) / (row_n[f, who, c] + C.SMOOTHING))
            m = max(s.values())
            z = sum(math.exp(x - m) for x in s.values())
            post[i] = {c: math.exp(x - m) / z for c, x in s.items()}
    return post


def test_equals_plain_em_and_finds_the_truth(spark):
    truth, rows = answers()
    got = {(r.job_id, r.field): (r.value, r.posterior) for r in C.consensus(spark.createDataFrame(rows, LABELS), rounds=5).collect()}
    want = plain_em(rows, 5)
    assert got.keys() == want.keys()
    for i, p in want.items():
        assert math.isclose(got[i][1], p[got[i][0]], abs_tol=1e-6) and math.isclose(got[i][1], max(p.values()), abs_tol=1e-6)
    assert sum(got[j, "f"][0] == t for j, t in truth.items()) >= 38


def test_rounds_blanks_doubles_and_few_people(spark):
    rows = [
        (1, "j", "f", " X ", "a", 1, T0), (2, "j", "f", "x", "b", 1, T0), (3, "j", "f", "y", "c", 1, T0), (4, "j", "f", "X", "c", 2, T0), (5, "j", "f", "X", "c", 2, T0),
        (6, "k", "f", "x", "a", 1, T0), (7, "k", "f", "x", "b", 1, T0), (8, "k", "f", "x", "c", 1, T0), (9, "k", "f", "  ", "c", 2, T0),
        (10, None, "f", "x", "a", 1, T0), (11, "j", None, "x", "a", 1, T0), (12, "j", "f", "z", None, 1, T0),
    ]
    df = spark.createDataFrame(rows, LABELS).selectExpr("*", "'q' as label", "1 as p", "2 as n")
    assert [(r.job_id, r.value, r.people) for r in C.consensus(df, rounds=2).collect()] == [("j", "x", 3)]
    assert C.consensus(df.limit(0), rounds=2).count() == 0
    tie = [(i, "t", "f", v, w, 1, T0) for i, (v, w) in enumerate([("b", "a"), ("a", "b"), ("c", "c")])]
    assert [r.value for r in C.consensus(spark.createDataFrame(tie, LABELS), rounds=2).collect()] == ["a"]


def test_rounds_end_when_counts_settle(spark):
    truth, rows = answers(80, seed=3)
    df = spark.createDataFrame(rows, LABELS)
    settled = {(r.job_id, r.field): r.value for r in C.consensus(df).collect()}
    clear = {i: max(p, key=p.get) for i, p in plain_em(rows, 200).items() if max(p.values()) > 0.55}
    assert len(clear) > 70 and all(settled[i] == v for i, v in clear.items())


def test_reliability_and_agreement(spark):
    _, rows = answers(60)
    df = spark.createDataFrame(rows, LABELS)
    acc = {r.labeller_id: r.accuracy for r in C.reliability(df, rounds=5).collect()}
    assert min(acc[w] for w in "abc") > 0.8 > 0.6 > max(acc[w] for w in "de")
    same = [(i, f"j{j}", "f", "xy"[j % 2], w, 1, T0) for i, (j, w) in enumerate(itertools.product(range(6), "abc"))]
    assert [(r.observed, r.alpha) for r in C.agreement(spark.createDataFrame(same, LABELS)).collect()] == [(1.0, 1.0)]


POSTINGS = "posting_no bigint, batch_no int, company_token string, company_name string, title string, description_text string"


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, no = [], 0
    for e in range(6):
        intro = " ".join(word() for _ in range(12))
        for role in ("Senior Data Analyst", "Nurse", "Site Reliability Engineer, search"):
            base = intro.split() + [word() for _ in range(90)]
            for kind in rng.sample(["same", "upper", "cut", "swap", "half", "html", "shuffle"], 4):
                w = list(base)
                if kind == "cut":
                    w = w[:80] + ["[more]"]
                if kind == "swap":
                    w = [x if rng.random() > 0.07 else word() for x in w]
                if kind == "half":
                    w = w[:40] + [word() for _ in range(60)]
                if kind == "shuffle":
                    parts = [w[i : i + 12] for i in range(0, len(w), 12)]
                    rng.shuffle(parts)
                    w = sum(parts, [])
                t = " ".join(w)
                t = {"upper": t.upper(), "html": "<p>" + t + "</p>"}.get(kind, t)
                title = rng.choice([role, role.upper(), role + " (reposted)", role.replace("Senior", "Sr.").replace("Engineer", "Eng.")])
                rows.append((no, no % 4, f"emp{e}fam{e}tok", f"Emp{e} Family Robotics Inc.", title, t))
                no += 1
    return rows


def brute(rows):
    info = [(r, H.words_of(r[5])) for r in rows if r[5] and H.words_of(r[5])]
    first = {r[0]: r[0] for r, _ in info}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for (a, wa), (b, wb) in itertools.combinations(info, 2):
        if a[2] == b[2] and H.role_of(a[4]) == H.role_of(b[4]):
            if H.coverage(*(g.view(np.int64) for g in H.shingles([wa, wb], H.WordCodes())), len(wa), len(wb)) >= H.COVERAGE:
                x, y = sorted((find(a[0]), find(b[0])))
                first[y] = x
    return sorted((find(n), n) for n in first if find(n) != n)


def found(spark, rows):
    df = spark.createDataFrame(rows, POSTINGS).selectExpr("*", "'q' as class", "1 as no", "'z' as k")
    return sorted(tuple(r) for r in H.repeated_postings(df).collect())


def test_batches_against_history_equal_brute_force(spark):
    rows = texts()
    want = brute(rows)
    assert len(want) > 20 and found(spark, rows) == want


def test_no_text_other_role_other_employer_and_empty(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, 0, "tok-one-two", "N", "Nurse", t), (2, 0, "tok-one-two", "N", "Analyst", t), (3, 1, "tok-three-four", "M", "Nurse", t), (4, 1, "tok-one-two", "N", "Nurse", None), (5, None, "tok-one-two", "N", "NURSE", t + " "), (6, 1, None, None, None, "   "), (7, 1, "tok-one-two", "N", "Nurse", "<p></p>"), (8, 2, "tok-one-two", "N", "Nurse", "one two")]
    assert found(spark, rows) == [(1, 5)]
    assert found(spark, rows[:0]) == []


ARGS = ("posting_no", "batch_no", "company_token", "company_name", "title", "description_text")


def ingest(spark, forest, rows):
    return {tuple(r) for r in forest.ingest(H.records(spark.createDataFrame(rows, POSTINGS), *ARGS)).collect()}


def test_chance_of_meeting_falls_with_depth():
    assert H.met(0.36, 1) > 0.999 > H.met(0.36, 2) > 0.85 and H.met(1.0, 2) == 1.0


def test_runs_are_merged_and_copies_stay_out(spark):
    rows = [(i, i, "tok-one-two", "N", "Nurse", "a b c d e f g h i j") for i in range(6)]
    f = H.Forest(spark)
    for i in range(5):
        assert ingest(spark, f, rows[i : i + 1]) == ({(0, i)} if i else set())
    assert len(f._of("exact")) < 5 and sum(t["rows"] for t in f._of("tree")) == H.TREES
    assert ingest(spark, f, [(20, 20, "tok-one-two", "N", "Nurse", "a b c d e f g h i x")]) == {(0, 20)}


def test_folder_opened_again_goes_on_and_opens_only_touched_files(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    history = [(i, 0, f"employer-{i}-token", None, f"Nurse {word()}", " ".join(word() for _ in range(30))) for i in range(60)]
    folder = str(tmp_path / "forest")
    ingest(spark, H.Forest(spark, folder, file_rows=40), history)
    f = H.Forest(spark, folder, file_rows=40)
    again = history[17]
    near = again[5].split()
    near[3] = "changed"
    assert ingest(spark, f, [(100, 1, *again[2:])]) == {(17, 100)}
    f = H.Forest(spark, folder, file_rows=40)
    assert f.count == 2 and ingest(spark, f, [(101, 2, *again[2:5], " ".join(near))]) == {(17, 101)}
    for kind, most in (("tree", 4), ("text", 4)):
        touched, there = f.opened[kind]
        assert there > 16 and touched <= most
    assert sorted(tuple(r) for r in f.links().collect()) == [(17, 100), (17, 101)]


def test_widening_ends_at_the_recall_target(spark):
    t = [f"word{i}" for i in range(80)]
    f = H.Forest(spark)
    ingest(spark, f, [(1, 0, "tok-one-two", "N", "Nurse", " ".join(t))])
    assert ingest(spark, f, [(2, 1, "tok-one-two", "N", "Nurse", " ".join([*t, "end"]))]) == {(1, 2)}
    assert f.depth == H.DEPTH and f.recall >= H.RECALL
    far = t[:60] + [f"other{i}" for i in range(18)]
    assert (1, 3) in ingest(spark, f, [(3, 2, "tok-one-two", "N", "Nurse", " ".join(far))])
    assert f.depth <= H.DEPTH


def test_a_copy_brings_its_name_into_the_forest(spark):
    t = [f"word{i}" for i in range(40)]
    rows = [(1, 0, "tok-one-two", None, "Nurse", " ".join(t)), (2, 1, "tok-one-two", "Vorrin Quell Robotics", "Nurse", " ".join(t)), (3, 2, "other-token-x", "Vorrin Quell Robotics", "Nurse", " ".join([*t, "more"])), (4, 2, None, None, "Nurse", " ".join(t)), (5, 3, None, None, "Nurse", " ".join(t))]
    assert found(spark, rows) == [(1, 2), (1, 3)]
