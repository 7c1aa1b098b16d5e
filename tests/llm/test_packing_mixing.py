"""Packing never splits or overfills; mixing keeps balances, shares and caps."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import mixing, packing, tokens

PACKS = "pack_name string, capacity_tokens int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 90))
def test_best_fit_equals_a_plain_scan(sizes, capacity):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room, want = [], {}
    for i in order:
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if fits:
            r = min(fits)[0]
            b = max(b for x, b in fits if x == r)
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        want[i] = b
    bins, left = packing.pack_sizes(np.array(sizes, dtype=np.int64), np.arange(len(sizes)), capacity)
    used = np.bincount(bins, weights=sizes, minlength=1) if sizes else np.zeros(1)
    assert (used <= capacity).all() and len(set(bins.tolist())) == len(room)
    assert sorted(used[used > 0].tolist()) == sorted(float(capacity - r) for r in room if r < capacity)


def test_pack_covers_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)
    rng = np.random.default_rng(1)
    sizes = [(int(i), int(s)) for i, s in enumerate(rng.integers(0, 400, 300))] + [(1000, 256), (1001, 5000), (1002, None), (None, 5)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").selectExpr("*", "'x' as pack_name", "1 as size", "2 as bin")
    rows = packing.pack(df, spark.createDataFrame([("s", 256), ("l", 4096), ("bad", 0)], PACKS)).collect()
    for name, cap in (("s", 256), ("l", 4096)):
        mine = [r for r in rows if r.pack_name == name]
        used = {}
        for r in mine:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
        assert max(used.values()) <= cap
        for d, n in sizes:
            spans = sorted((r.first_token, r.last_token) for r in mine if r.doc_id == d)
            if d is not None and n:
                assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
                assert len(spans) == -(-n // cap)
            elif d is not None:
                assert spans == []
        assert sum(used.values()) / (len(used) * cap) > 0.95
    assert packing.pack(df.limit(0), spark.createDataFrame([("s", 256)], PACKS)).count() == 0
    assert packing.pack(df, spark.createDataFrame([], PACKS)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=3, max_size=60), st.floats(0.05, 0.95), st.integers(0, 99))
def test_flight_keeps_both_sums(sizes, share, seed):
    x = np.array(sizes, dtype=float)
    p = np.full(len(x), share)
    q = mixing.flight(p, x, np.random.default_rng(seed))
    assert np.isclose(q.sum(), p.sum()) and np.isclose((q * x).sum(), (p * x).sum())
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and (q >= 0).all() and (q <= 1).all()
    assert set(np.round(mixing.land(q, x), 9)) <= {0.0, 1.0}


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 200)
    rng = np.random.default_rng(2)
    docs, sizes = [], []
    for i in range(3000):
        docs.append((i, f"text {i}", "big" if i < 2000 else "mid" if i < 2900 else "small"))
        sizes.append((i, int(rng.integers(20, 300))))
    docs += [(5000, "text 1", "small"), (5001, None, "big"), (5002, "", "big"), (5003, "q", None), (5004, "z", "other")]
    sizes += [(5000, sizes[1][1]), (5001, 0), (5002, 0), (5003, 9), (5004, 9)]
    n = dict(sizes)
    d = spark.createDataFrame([(*x, n[x[0]]) for x in docs], "doc_id bigint, text string, source string, n_tokens bigint").selectExpr("*", "sha2(text, 256) as digest", "1 as p", "2 as rate")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 3), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    sel, r = mixing.mix(d, t)
    rep = {x.source: x for x in mixing.shares(sel, r).collect()}
    for name, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(rep[name].actual_share - want) < 0.002 and rep[name].most_repeats <= rep[name].max_repeats
    assert rep["none"].used_tokens == rep["zero"].used_tokens == 0
    rows = sel.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and 5000 not in {x.doc_id for x in rows} and 5003 not in {x.doc_id for x in rows}
    fixed, fr = mixing.mix(d, t, total_tokens=20_000)
    assert abs(sum(x.n_tokens * x.repeats for x in fixed.collect()) - 20_000) < 600
    assert mixing.mix(d.limit(0), t)[0].count() == 0


def test_token_counts_are_exact_round_trips(spark):
    enc = tokens.load()
    texts = ["Hello  world", "東京 de l'été", "", None, "x" * 5000, "a\n\n\tb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len(enc.encode_ordinary(t)) if t else 0)
        assert not t or enc.decode(enc.encode_ordinary(t)) == t


@pytest.mark.parametrize("capacity", [1, 7])
def test_tiny_capacities(spark, capacity):
    df = spark.createDataFrame([(1, 3), (2, 7), (3, 1)], "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, spark.createDataFrame([("t", capacity)], PACKS)).collect()
    assert sum(r.n_tokens for r in rows) == 11 and max(r.n_tokens for r in rows) <= capacity
