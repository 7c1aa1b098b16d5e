"""Linking of typed organisation names: parts, similarity join without losses, clustering, decisions by token."""

import itertools
import math
import random

import pytest

from lodestar.llm import entities
from lodestar.llm.names import one_edit, parse_name, parse_token
from lodestar.operators import graphs
from lodestar.session import materialize

SCHEMA = "company_id bigint, company_name string, company_token string"


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in entities.linked_pairs(entities.link_names(df)).collect())


@pytest.mark.parametrize(
    "name, want",
    [
        ("The Theodore Kosöfo Fispranprar Technologies Co. dba Kosofo", ("theodore", ("kosofo", "fispranprar"), "technologies", "co")),
        ("Technologies, Ted Kosofo Fispranprar", ("theodore", ("kosofo", "fispranprar"), "technologies", None)),
        ("KysenaChekfisher Mgmt L.L.C.", (None, ("kysena", "chekfisher"), "management", "llc")),
        ("Fispranprar & Kosofo Hlth Grp.", (None, ("fispranprar", "kosofo"), "health", "group")),
        ("Tifeke Helrorron Engy Group", (None, ("tifeke", "helrorron"), "energy", "group")),
    ],
)
def test_name_parts(name, want):
    n = parse_name(name)
    assert (n.founder, n.family, n.trade, n.legal) == want


def test_odd_names():
    assert parse_name("B. F. E LLC").initials == "bfe" and parse_name("E. Pomoda/Shasrordrol Group").founder_initial == "e"
    for raw in (None, "", "  ", "!!!", "LLC", "x" * 100_000):
        parse_name(raw)
        parse_token(raw)
    assert parse_token("theodore-kosofo-fispranprar-technologies-careers").trade == "technologies"
    assert parse_token("ludigi-gunjolfin").trade is None
    assert one_edit("abc", "acb") and one_edit("abc", "ab") and not one_edit("abc", "xyz")


def test_trade_and_founder_tell_employers_apart(spark):
    rows = [
        (1, "Muloda Quingurshal Health Corp.", "muloda-quingurshal-health"),
        (2, "Muloda Quingurshal Hlth Corp", None),
        (3, "Quingurshal & Muloda Health Corp. dba Muloda", None),
        (4, "Mulodda Quingurshal Insurance Inc.", "muloda-quingurshal-insurance"),
        (5, "Muloda Quingurshal Corp.", "muloda-quingurshal-health-us"),
        (6, "M. Q. H Corp.", "muloda-quingurshal-health1"),
        (7, "Someone Else Robotics Ltd.", "someone-else"),
        (8, None, None),
        (9, "", "muloda-quingurshal-insurance"),
    ]
    got = pairs(spark, rows)
    assert got == sorted([*itertools.combinations([1, 2, 3, 5, 6], 2), (4, 9)])


def test_repeats_empty_and_clashing_columns(spark):
    rows = [(1, "Gefase Nerprarlil Technologies Ltd.", "gefasenerprarlil"), (2, "Gefase Nerprarlil Technologies Ltd.", "gefasenerprarlil"), (2, "Gefase Nerprarlil Technologies Ltd.", "gefasenerprarlil")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as family", "'y' as form", "1 as id", "'z' as trade", "'q' as token")
    assert [tuple(r) for r in entities.linked_pairs(entities.link_names(df)).collect()] == [(1, 2)]
    assert entities.linked_pairs(entities.link_names(df.limit(0))).count() == 0


def test_names_too_short_for_a_vector(spark):
    rows = [(1, "IBM", "ibm"), (2, "ibm", "IBM"), (3, "東京", None), (4, "東京", None), (5, "TQL", None), (6, "TQL", None), (7, None, "abc"), (8, None, None), (9, "!!!", None), (10, "大阪", None), (11, "Ox", "gefasenerprarlil"), (12, "Gefase Nerprarlil Technologies", "gefasenerprarlil")]
    df = spark.createDataFrame(rows, SCHEMA)
    links = entities.link_names(df)
    assert sorted(tuple(r) for r in entities.linked_pairs(links).collect()) == [(1, 2), (3, 4), (11, 12)]
    assert sorted(tuple(r) for r in entities.members(links).collect())[:4] == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2)]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_similarity_join_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(entities, "HOT", hot)
    rng = random.Random(5)
    words = ["".join(rng.choice("ron gul chel mos pras quin".split()) for _ in range(3)) for _ in range(40)]
    words += [w[:3] + w[4:] for w in words[:20]] + [w[:5] + "x" + w[5:] for w in words[10:30]]
    forms = materialize(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "form string"))
    vec = {}
    for r in entities.gram_vectors(forms).collect():
        vec.setdefault(r.form, {})[r.gram] = r.w
    want = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        c = sum(w * vec[b].get(g, 0.0) for g, w in vec[a].items())
        if c >= 0.4:
            want[a, b] = c
    got = {(r.u, r.v): r.sim for r in entities.similar_forms(forms, 0.4, edits=-1.0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_two_typos_leave_a_spelling_in_its_family(spark):
    variants = [("sharjoldror sikuni", "shatjoldror sikini"), ("kanfirher lekeli", "kanfurher lekli"), ("dioku quiemornel", "disoku quirmornel")]
    parts = materialize(spark.createDataFrame([(f, None) for v in variants for f in v], "name_form string, token_form string"))
    family = {r.form: r.family for r in entities.families(parts).collect()}
    assert all(family[a] == family[b] for a, b in variants) and len(set(family.values())) == 3


def agglomerate(n, sim, threshold):
    clusters = [{i} for i in range(n)]
    while len(clusters) > 1:
        best = max(((sum(sim.get((min(i, j), max(i, j)), 0) for i in a for j in b) / (len(a) * len(b)), x, y) for (x, a), (y, b) in itertools.combinations(enumerate(clusters), 2)), key=lambda t: (t[0], -t[1], -t[2]))
        if best[0] < threshold:
            break
        clusters[best[1]] |= clusters.pop(best[2])
    return sorted(tuple(sorted(c)) for c in clusters)


def test_average_linkage_equals_one_merge_at_a_time(spark):
    rng = random.Random(2)
    sim = {(i, j): rng.random() for i, j in itertools.combinations(range(24), 2) if rng.random() < 0.4}
    edges = spark.createDataFrame([(f"{i:02d}", f"{j:02d}", s) for (i, j), s in sim.items()], "u string, v string, sim double")
    got = {}
    for r in graphs.average_linkage(edges, 0.35).collect():
        got.setdefault(r.cluster, []).append(int(r.node))
    linked = sorted(tuple(sorted(c)) for c in got.values())
    want = agglomerate(24, sim, 0.35)
    assert [c for c in linked if len(c) > 1] == [c for c in want if len(c) > 1]


def test_linkage_weighs_members_and_pairs_without_an_edge(spark):
    # b stands for five members; c has no edge with a but shares grams with it
    vecs = {"a": ({"x": 1.0}, 1), "b": ({"x": 4.0, "y": 3.0}, 5), "c": ({"x": 0.6, "y": 0.8}, 1), "d": ({"y": 1.0}, 1)}
    rows = [(k, g, w, n) for k, (v, n) in vecs.items() for g, w in v.items()]
    vectors = spark.createDataFrame(rows, "node string, gram string, w double, n bigint")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5)], "u string, v string, sim double")
    # a-b 4/5, b-c 4.8/5; then a against b and c: (4 + 0.6) / 6 = 0.767 (without the pair a-c 0.667)
    got = {r.node: r.cluster for r in graphs.average_linkage(edges, 0.7, vectors).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}
    assert {r.node: r.cluster for r in graphs.average_linkage(edges, 0.78, vectors).collect()} == {"a": "a", "b": "b", "c": "b"}


def test_linkage_goes_on_until_no_merge_is_left(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MAX_ROUNDS", 2)
    edges = spark.createDataFrame([("a", k, 1 - i / 100) for i, k in enumerate("bcdef")] + [(x, y, 0.5) for x, y in itertools.combinations("bcdef", 2)], "u string, v string, sim double")
    assert {r.cluster for r in graphs.average_linkage(edges, 0.3).collect()} == {"a"}
    with pytest.raises(RuntimeError):
        graphs.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint"), "a", "b")


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            nxt.append(min(row[j] + (x != y), row[j + 1] + 1, nxt[-1] + 1))
        row = nxt
    return row[-1]


def test_spellings_meet_by_what_edits_leave():
    rng = random.Random(5)
    sound = ["mol", "shan", "gur", "jos", "hel", "quin", "bas", "ror", "lin", "ches"]
    names = ["".join(rng.choice("bdfgkl") + rng.choice("aeiou") for _ in range(rng.choice([1, 3, 3, 5]))) + "".join(rng.choices(sound, k=rng.choice([0, 3, 3, 4]))) for _ in range(250)]
    for s in names[:150]:
        for _ in range(rng.randrange(1, len(s) // 4 + 2)):
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice(["", "x", s[at] + "o"]) + s[at + 1 :]
        names.append(s)
    names = sorted(set(names), key=lambda s: (-len(s), s))
    keys = [tuple(map(set, entities.spelling_keys(s, 0.75))) for s in names]
    close = met = 0
    for i, s in enumerate(names):
        for j in range(i + 1, len(names)):
            meet = bool(keys[i][0] & keys[j][1])
            met += meet
            if _distance(s, names[j]) <= math.floor(0.25 * len(s)):
                close += 1
                assert meet, (s, names[j])
    assert close > 50 and met < 0.02 * len(names) * (len(names) - 1) / 2  # names of ten sounds nearly all share a gram


def test_close_forms_by_spelling_or_grams(spark):
    names = ["alda morin tesk", "tesk morin alda", "morintesk alda", "aldamorintesk", "aldamorimtesk", "fogu jorhesban", "fogujorhesbam", "jorhesbanfogu", "fogu jorhesbin", "fuga morhelban", "abcd", "abce", "xbce"]
    forms = spark.createDataFrame([(n,) for n in names], "form string")
    flat, turned = [n.replace(" ", "") for n in names], ["".join(reversed(n.split(" "))) for n in names]
    want = set()
    for i, u in enumerate(names):
        for j, v in enumerate(names):
            most = math.floor(0.25 * max(len(flat[i]), len(flat[j])))
            if u < v and min(_distance(flat[i], flat[j]), _distance(turned[i], flat[j]), _distance(flat[i], turned[j])) <= most:
                want.add((u, v))
    assert {(r.u, r.v) for r in entities.similar_forms(forms, 0.0).collect()} == want and len(want) > 8
