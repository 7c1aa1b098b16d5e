"""Canonical mapping and sentence units on fixtures with known answers."""

import re
import time

import pytest

from lodestar.llm.canonical import edit_distance, map_values, typed_values
from lodestar.llm.sentences import sentence_spans, split_sentences

REF = [
    (1, "location_raw", "New York, NY", "New York City|NYC"), (2, "location_raw", "Portland, OR", None), (3, "location_raw", "Portland, ME", None), (4, "location_raw", "Brooklyn, NY", None), (5, "location_raw", "Remote", "WFH"), (6, "location_raw", "Washington, DC", "Washington D.C."), (7, "location_raw", "Tokyo, Japan", "東京"), (8, "location_raw", "Seattle, WA", None),
    (10, "department", "Product Management", "Product"), (11, "department", "Project Management", "PMO"), (12, "department", "Data & Analytics", "Data|BI"), (13, "department", "Research", "R&D"), (14, "department", "Operations", "Ops"),
    (20, "seniority_level", "senior", None), (21, "seniority_level", "mid", None), (22, "seniority_level", "new_grad", None), (23, "seniority_level", "director", None),
]
CASES = [
    ("location_raw", "  New York,NY", 1), ("location_raw", "Onsite: Brooklyn, New York", 4), ("location_raw", "US-OR-Portland", 2), ("location_raw", "Portland, Maine", 3), ("location_raw", "Portland", -1), ("location_raw", "Seattle, Washington", 8), ("location_raw", "Nrw York, NY", 1), ("location_raw", "100% Remote", 5), ("location_raw", "東京", 7), ("location_raw", "Port Senna, Talvik", -1), ("location_raw", "", -1), ("location_raw", "???", -1), ("location_raw", "y" * 60_000, -1),
    ("department", "Success Product", 10), ("department", "Project Heron", -1), ("department", "Management Project", 11), ("department", "R&D team", 13), ("department", "Operatns", 14), ("department", "Data and Analytics", 12),
    ("seniority_level", "mid-senior: mid", 21), ("seniority_level", "Sr Director", 23), ("seniority_level", "seniour", 20), ("seniority_level", "NEW-GRAD", 22), ("seniority_level", "Grade C", -1),
]


def refs(spark):
    return spark.createDataFrame(REF, "ref_id int, ref_field string, ref_value string, alt_names string")


@pytest.mark.parametrize("limit", [100, 2])
def test_mapping_whole_and_in_blocks(spark, limit):
    df = spark.createDataFrame([(str(i), f, v) for i, (f, v, _) in enumerate(CASES)] + [("n", "department", None)], "id string, field_name string, value string").selectExpr("*", "1 as score", "'x' as ref_id")
    got = {r.id: r.ref_id for r in map_values(df, refs(spark), max_entries=limit).collect()}
    assert {CASES[int(k)][:2]: v for k, v in got.items()} == {c[:2]: c[2] for c in CASES}


def test_shared_aliases_and_ties_are_the_same_in_blocks(spark):
    ref = spark.createDataFrame([(1, "f", "Alpha Works", "widget"), (2, "f", "Beta Works", "widget"), (3, "f", "Gamma Hall", "gadget"), (4, "f", "Gamma Halt", "sprocket"), (5, "f", "Deltas", "gizmos")], "ref_id int, ref_field string, ref_value string, alt_names string")
    typed = ["widget", "gadget and gizmos", "gizmos and gadget", "Gamma Hal", "sprocket gadget", "Beta Worsk", "a widget, a gadget"]
    df = spark.createDataFrame([(str(i), "f", v) for i, v in enumerate(typed)], "id string, field_name string, value string")
    got = [{r.id: (r.ref_id, round(r.score, 9)) for r in map_values(df, ref, max_entries=n).collect()} for n in (100, 2, 1)]
    assert got[0] == got[1] == got[2]
    assert [got[0][str(i)][0] for i in range(len(typed))] == [-1, 3, 5, -1, 4, 2, 3]


def test_mapping_empty_and_typed_values(spark):
    df = spark.createDataFrame([("a", "Research", None)], "id string, department string, location_raw string")
    v = typed_values([(df, "id", ["department", "location_raw"])])
    assert sorted((r.field_name, r.ref_id) for r in map_values(v, refs(spark)).collect()) == [("department", 13)]
    assert map_values(v.limit(0), refs(spark)).count() == 0
    assert [r.ref_id for r in map_values(v, refs(spark).limit(0)).collect()] == [-1]


def test_edit_distance():
    assert edit_distance("remtoe", "remote", 3) == 1 and edit_distance("abc", "xyz", 1) == 2 and edit_distance("", "ab", 5) == 2


SENTENCES = [
    ("Dr. Lumbré founded it. Ask Ms. Okafye or Mr. Brovik.", ["Dr. Lumbré founded it.", "Ask Ms. Okafye or Mr. Brovik."]),
    ("We pay approx. 35.7 percent. Version 8.10.6 went live. npm and pip run daily.", ["We pay approx. 35.7 percent.", "Version 8.10.6 went live.", "npm and pip run daily."]),
    ("Most of our clients are in the U.S. Every colleague agrees. The U.S. Desk opens late.", ["Most of our clients are in the U.S.", "Every colleague agrees.", "The U.S. Desk opens late."]),
    ("The day ends at 3 p.m. Doors open at 2:30 a.m. and close.", ["The day ends at 3 p.m.", "Doors open at 2:30 a.m. and close."]),
    ("“We ship on Fridays. We rest on Mondays.” says the lead. “Bring your own questions.” J. R. Okrand will chair (cf. section 4.9). (Travel is rare.) Next.", ["“We ship on Fridays. We rest on Mondays.” says the lead.", "“Bring your own questions.”", "J. R. Okrand will chair (cf. section 4.9).", "(Travel is rare.)", "Next."]),
    ('"Is it urgent? Then call us!" is what she says. Really?! Well... it depends. What a year it has been... Each squad left.', ['"Is it urgent? Then call us!" is what she says.', "Really?!", "Well... it depends.", "What a year it has been...", "Each squad left."]),
    ("Sie arbeiten z. B. mit Kafka. Im 2. Quartal ziehen wir um, bis zum 14. Mai. Nr. 351. Haben Sie Fragen?", ["Sie arbeiten z. B. mit Kafka.", "Im 2. Quartal ziehen wir um, bis zum 14. Mai.", "Nr. 351.", "Haben Sie Fragen?"]),
    ("Vous utilisez p. ex. Docker. « On avance. On ne court pas. » dit Mme Ilmari. M. Okafye rédige.", ["Vous utilisez p. ex. Docker.", "« On avance. On ne court pas. » dit Mme Ilmari.", "M. Okafye rédige."]),
    ("El Sr. Tamsin mide. Ud. recibirá la pág. 7. ¿Te gusta Excel? ¡Sí!", ["El Sr. Tamsin mide.", "Ud. recibirá la pág. 7.", "¿Te gusta Excel?", "¡Sí!"]),
    ("「まず試す。次に直す。」とOkafyeさんは言います。給与は月625千円です（賞与は別です）。本当に？！", ["「まず試す。次に直す。」とOkafyeさんは言います。", "給与は月625千円です（賞与は別です）。", "本当に？！"]),
    ("“先想清楚。再动手。”Lumbré经常这样说。事情还没有结束……我们继续努力。", ["“先想清楚。再动手。”Lumbré经常这样说。", "事情还没有结束……我们继续努力。"]),
    ("“धीरे चलो। सही चलो।” Okrand कहते हैं। डॉ. Okrand आए।", ["“धीरे चलो। सही चलो।” Okrand कहते हैं।", "डॉ. Okrand आए।"]),
    ("«نعمل بهدوء. نصل معا.» هكذا تقول أ. Okafye. مدة العقد 3 أشهر.", ["«نعمل بهدوء. نصل معا.» هكذا تقول أ. Okafye.", "مدة العقد 3 أشهر."]),
    ("เราไม่มีการทำงาน สัญญาจ้าง 8 เดือนเท่านั้น เราใช้ Linux ทุกวัน", ["เราไม่มีการทำงาน", "สัญญาจ้าง 8 เดือนเท่านั้น", "เราใช้ Linux ทุกวัน"]),
    ("Nice to have:\n- One thing. Two things\n- Next\n\nAbout us\n\nWrapped\nline here. And\nmore.", ["Nice to have:", "- One thing.", "Two things", "- Next", "About us", "Wrapped\nline here.", "And\nmore."]),
    ("The job is in Dept.\n638, bldg.\n11. It ends.", ["The job is in Dept.\n638, bldg.\n11.", "It ends."]),
    ("plan ahead.Candidates wait.Fig. 3 shows it. Mail jobs@Velliste.example or see www.Okrand.example/apply.html today.", ["plan ahead.", "Candidates wait.", "Fig. 3 shows it.", "Mail jobs@Velliste.example or see www.Okrand.example/apply.html today."]),
    ('He said "stop. And left. Then came back.', ['He said "stop.', "And left.", "Then came back."]),
]


@pytest.mark.parametrize("text, want", SENTENCES)
def test_units(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


@pytest.mark.parametrize("text", [None, "", " \n\t ", "...", "((((", "”””", "a" * 300_000, "“" * 500 + " x. Y. ", "\n\n- \n* \n1. ", "x. " * 20_000])
def test_odd_texts_are_covered(text):
    spans = sentence_spans(text)
    t = text or ""
    assert re.sub(r"\s", "", "".join(t[a:b] for a, b in spans)) == re.sub(r"\s", "", t)
    assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)


@pytest.mark.parametrize("text", ["(" * 100_000, '("' * 50_000, "A." * 200_000, "a@b." * 50_000])
def test_unclosed_marks_and_long_tokens_are_read_once(text):
    began = time.time()
    assert sentence_spans(text) == [(0, len(text))] and time.time() - began < 10


def test_split_operator(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, "")], "doc_id bigint, text string").selectExpr("*", "'x' as k", "'y' as t", "0 as sent_start")
    assert sorted(tuple(r) for r in split_sentences(df).collect()) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert split_sentences(df.limit(0)).count() == 0
