"""Pay in common units: every way of writing, precedence of text and columns, rounding."""

from decimal import Decimal

import pytest

from lodestar.operators.units import PayParser, number, yearly_pay

SCHEMA = "id string, salary string, comp_min double, comp_max double, comp_currency string"
FX = [("USD", 1.0), ("EUR", 1.085), ("CAD", 0.734), ("AUD", 0.657), ("INR", 0.0119), ("JPY", 0.0068), ("GBP", 1.271), ("CHF", 1.129)]
UNITS = [("hour", 2080), ("day", 260), ("week", 52), ("month", 12), ("year", 1)]


def run(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], SCHEMA)
    fx, per = spark.createDataFrame(FX, "currency string, usd_per_unit double"), spark.createDataFrame(UNITS, "pay_period string, per_year int")
    return {r.id: (r.usd_year_min, r.usd_year_max) for r in yearly_pay(df, fx, per).collect()}


CASES = [
    (("$50k-$55k p.a. • Offers Equity", None, None, "USD"), (50_000, 55_000)),
    (("$136–168k", None, None, None), (136_000, 168_000)),
    (("INR 90 – 114.5 LPA", None, None, None), (107_100, 136_255)),
    (("年収 1107 – 1484万円", None, None, None), (75_276, 100_912)),
    (("starting at $900 per week", None, None, None), (46_800, -1)),
    (("max. 260 CAD per day", None, None, None), (-1, 49_618)),
    (("to $144,000 / year", None, None, "CAD"), (-1, 105_696)),
    (("€13-17,50 / heure + equity", None, None, None), (29_338, 39_494)),
    (("€1 480–€1.920 pro Woche", None, None, None), (83_502, 108_326)),
    (("₹30,00,000 per annum", None, None, None), (35_700, 35_700)),
    (("A$11,500/mo", None, None, None), (90_666, 90_666)),
    (("monthly gross, amounts in cents", 680_000.0, 755_000.0, "EUR"), (88_536, 98_301)),
    (("hourly, minor units", 2_000.0, 2_500.0, "jpy"), (28_288, 35_360)),
    (("yearly, amounts x1000", 77.5, 92.0, "usd"), (77_500, 92_000)),
    (("per year + bonus", 146_000.0, 131_000.0, "CAD"), (96_154, 107_164)),
    ((None, 44_000.0, 48_000.0, "£"), (55_924, 61_008)),
    (("100500 EUR", None, None, None), (109_043, 109_043)),  # .5 goes up
    (("$95,000 plus $5,000 sign-on bonus", None, None, None), (95_000, 95_000)),
]


def test_cases(spark):
    got = run(spark, [c[0] for c in CASES])
    assert {c[0][0]: got.get(str(i)) for i, c in enumerate(CASES)} == {c[0][0]: c[1] for c in CASES}


def test_not_pay(spark):
    for text in ("401(k) match up to 4%", "0.5% equity", "$5,000 sign-on bonus", "DOE", "", "   ", "competitive " * 5000, None):
        assert run(spark, [(text, None, None, "USD")]) == {}


def test_one_column_unknown_currency_repeats_empty(spark):
    assert run(spark, [("per month", 1000.0, None, "USD")]) == {"0": (12_000, -1)}
    assert run(spark, [("50,000 XYZ", None, None, "XYZ")]) == {"0": (50_000, 50_000)}
    df = spark.createDataFrame([("a", "$10/hr", None, None, None)] * 2, SCHEMA).selectExpr("*", "'x' as currency", "1 as rate", "'y' as t")
    fx, per = spark.createDataFrame(FX, "currency string, usd_per_unit double"), spark.createDataFrame(UNITS, "pay_period string, per_year int")
    assert [tuple(r) for r in yearly_pay(df, fx, per).collect()] == [("a", 20_800, 20_800)]
    assert yearly_pay(df.limit(0), fx, per).count() == 0


@pytest.mark.parametrize("text, want", [("1.500", 1500), ("1,5", "1.5"), ("1.234.567,89", "1234567.89"), ("30,00,000", 3_000_000), ("12'000", 12_000), ("0.500", "0.5"), ("10 000", 10_000), ("1,234.5", "1234.5")])
def test_numbers(text, want):
    assert number(text) == Decimal(want)


def test_longest_alias_wins():
    assert PayParser()("A$100k")[2] == "AUD" and PayParser()("US$ 5")[2] == "USD" and PayParser()("$ 5")[2] == "$"
