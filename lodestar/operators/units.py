"""Quantities recorded in different units to one unit: yearly pay in one currency.

One automaton pass over a pay text finds the unit aliases (currency, period, scale, words that bound a
range, words for what is not pay); numbers are found beside them. The longest match wins ("a$" over
"$"), field context settles the rest (a bare ``$`` follows the currency column, a scale after a range
holds for both ends). The factors are then joined from small tables and multiplied as decimals.

Defined results: an end that is not stated is -1; a single amount is both ends; "from" and "up to"
state one end; text without a pay amount leaves the numeric columns, which take the text's units or else
whole units per year; unknown currencies, and rows without any stated end, give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.automaton import AliasAutomaton
from lodestar.session import small_side

CURRENCY = {
    "USD": ["usd", "us$", "u.s. dollars", "u.s. dollar", "us dollars", "us dollar", "u.s.$"],
    "EUR": ["eur", "euro", "euros", "€"],
    "GBP": ["gbp", "£", "pounds", "sterling", "pounds sterling"],
    "CAD": ["cad", "c$", "ca$", "canadian dollars"],
    "AUD": ["aud", "a$", "au$", "australian dollars"],
    "INR": ["inr", "rs.", "rs", "₹", "rupees"],
    "JPY": ["jpy", "yen", "¥", "円"],
    "CHF": ["chf", "sfr", "sfr.", "francs"],
    "$": ["$", "dollars", "dollar"],
}
PERIOD = {
    "hour": ["per hour", "an hour", "a hour", "/hour", "/ hour", "hourly", "/hr", "/ hr", "per hr", "p/h", "p.h.", "hour", "hr", "hrs", "/h", "pro stunde", "/ stunde", "/stunde", "stunde", "/ heure", "/heure", "par heure", "de l'heure", "heure", "por hora", "時給", "时薪"],
    "day": ["per day", "a day", "/day", "/ day", "daily", "daily rate", "day rate", "p.d.", "p/d", "per diem", "/d", "pro tag", "/tag", "/ tag", "tag", "par jour", "/ jour", "/jour", "por día", "日給", "日薪", "day"],
    "week": ["per week", "a week", "/week", "/ week", "weekly", "/wk", "/ wk", "per wk", "p.w.", "p/w", "pro woche", "/woche", "/ woche", "woche", "par semaine", "/ semaine", "/semaine", "por semana", "週給", "week"],
    "month": ["per month", "a month", "/month", "/ month", "monthly", "/mo", "/ mo", "per mo", "p.m.", "p/m", "pcm", "pro monat", "/monat", "/ monat", "monat", "par mois", "/ mois", "/mois", "mois", "al mes", "月給", "月薪", "month"],
    "year": ["per year", "a year", "/year", "/ year", "yearly", "/yr", "/ yr", "per yr", "per annum", "p.a.", "p/a", "pa", "annually", "annual", "/annum", "pro jahr", "/jahr", "/ jahr", "jahr", "par an", "/ an", "/an", "al año", "年収", "年俸", "年薪", "year"],
}
#: Scale words: factor, currency they imply, period they imply.
SCALE = {
    "k": ("1000", "", ""), "(k)": ("1000", "", ""), "thousand": ("1000", "", ""), "thousands": ("1000", "", ""), "tsd": ("1000", "", ""), "x1000": ("1000", "", ""), "x 1000": ("1000", "", ""), "千": ("1000", "", ""),
    "m": ("1000000", "", ""), "mn": ("1000000", "", ""), "mio": ("1000000", "", ""), "million": ("1000000", "", ""), "millions": ("1000000", "", ""),
    "lakh": ("100000", "INR", ""), "lakhs": ("100000", "INR", ""), "lac": ("100000", "INR", ""), "lacs": ("100000", "INR", ""), "lpa": ("100000", "INR", "year"),
    "crore": ("10000000", "INR", ""), "crores": ("10000000", "INR", ""), "cr": ("10000000", "INR", ""),
    "万": ("10000", "", ""), "万円": ("10000", "JPY", ""), "万元": ("10000", "CNY", ""),
    "cents": ("0.01", "", ""), "in cents": ("0.01", "", ""), "amounts in cents": ("0.01", "", ""), "minor units": ("0.01", "", ""), "in minor units": ("0.01", "", ""), "pence": ("0.01", "", ""),
}
LOWER = ["from", "starting at", "starting from", "min", "min.", "minimum", "at least", "ab", "dès", "à partir de", "desde", "over"]
UPPER = ["up to", "max", "max.", "maximum", "at most", "bis zu", "jusqu'à", "hasta", "under", "less than"]
NOT_PAY = ["bonus", "sign-on bonus", "signing bonus", "sign-on", "equity", "stock", "shares", "options", "benefits", "401(k)", "401k", "401 (k)", "match", "relocation", "pension", "commission", "stipend", "allowance"]
#: Currencies whose minor unit is the unit itself.
NO_MINOR = {"JPY"}
DOLLARS = {"USD", "CAD", "AUD"}
NUMBER = re.compile(r"\d{1,3}(?:[ \u00a0\u2009\u202f'\u2019]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)*")
JOIN = re.compile(r"\s*(?:-|–|—|~|to|bis|à|a|until)\s*")


def aliases() -> dict[str, tuple]:
    """All aliases with (kind, value)."""
    out: dict[str, tuple] = {}
    for kind, names in (("currency", CURRENCY), ("period", PERIOD)):
        for value, words in names.items():
            out.update({w: (kind, value) for w in words})
    out.update({w: ("scale", v) for w, v in SCALE.items()})
    for kind, words in (("lower", LOWER), ("upper", UPPER), ("not_pay", NOT_PAY)):
        out.update({w: (kind, w) for w in words})
    return out


def number(text: str) -> Decimal:
    """A number in any of the usual ways to write thousands and decimals."""
    s = re.sub(r"[ \u00a0\u2009\u202f'\u2019]", "", text)
    marks = [c for c in s if c in ".,"]
    if marks:
        last, tail = marks[-1], len(s) - max(s.rfind("."), s.rfind(",")) - 1
        decimal = tail != 3 if len(set(marks)) == 1 else True
        if len(set(marks)) == 1 and len(marks) > 1:
            decimal = False
        if len(marks) == 1 and tail == 3 and s.split(last)[0] in ("0", ""):
            decimal = True
        head, _, rest = s.rpartition(last)
        s = re.sub(r"[.,]", "", head) + "." + rest if decimal else re.sub(r"[.,]", "", s)
    return Decimal(s)


class PayParser:
    """Reads a pay text: amounts in whole units of a currency per period."""

    def __init__(self) -> None:
        self.automaton = AliasAutomaton(aliases())

    def __call__(self, text: str) -> tuple:
        """(low, high, currency, period, scale): amounts already scaled, or None; scale of the numeric columns."""
        t = text.lower()
        hits = self.automaton.find(t)
        excluded = [(a, b) for a, b, _, (k, _v) in hits if k == "not_pay"]
        amounts = []
        for m in NUMBER.finditer(t):
            a, b = m.span()
            if any(x < b and a < y for x, y in excluded) or re.match(r"\s*%", t[b:]):
                continue
            if any(x < b and a < y for x, y, _, (k, _v) in hits if k == "scale" and x < a):
                continue  # the 1000 of x1000
            unit_end = b
            scale = None
            for x, y, _, (k, v) in hits:
                if k == "scale" and x >= b and not t[b:x].strip() and Decimal(v[0]) >= 1:
                    scale, unit_end = v, y
                if k == "currency" and x >= unit_end and not t[unit_end:x].strip():
                    unit_end = y
            if any(x >= unit_end and not t[unit_end:x].strip() for x, _ in excluded):
                continue  # "$5,000 sign-on bonus"
            if any(y <= a and re.fullmatch(r"\s*(?:of|:|up to|is)?\s*(?:us|a|c)?[$€£₹¥]?\s*", t[y:a]) for _, y in excluded):
                continue  # "bonus of $5,000", "match up to 4"
            amounts.append([number(m.group()), scale, a, unit_end])
        currency = next((v for *_, (k, v) in hits if k == "currency"), "")
        period = next((v for *_, (k, v) in hits if k == "period"), "")
        scales = [v for *_, (k, v) in hits if k == "scale"]
        for s in scales:
            currency, period = currency or s[1], period or s[2]
        if not amounts:
            factor = Decimal(scales[0][0]) if scales else Decimal(1)
            return None, None, currency, period, factor
        if len(amounts) > 1 and not JOIN.fullmatch(re.sub(r"[$€£₹¥]|\b(?:usd|eur|gbp|cad|aud|inr|jpy|chf|us|a|c)(?=\s|$|\d)", "", t[amounts[0][3] : amounts[1][2]])) and not JOIN.match(t[amounts[0][3] :]):
            amounts = amounts[:1]
        amounts = amounts[:2]
        if len(amounts) == 2:
            lo, hi = amounts
            if lo[1] is None and hi[1] is not None and lo[0] <= hi[0]:
                lo[1] = hi[1]
            if hi[1] is None and lo[1] is not None and lo[0] <= hi[0] < lo[0] * Decimal(lo[1][0]):
                hi[1] = lo[1]
        values = [x[0] * Decimal(x[1][0] if x[1] else 1) for x in amounts]
        if any(Decimal(s[0]) < 1 for s in scales):
            values = [v * Decimal("0.01") if currency not in NO_MINOR else v for v in values]
        if len(values) == 2:
            return values[0], values[1], currency, period, Decimal(1)
        before = t[: amounts[0][2]]
        kinds = [k for x, y, _, (k, _v) in hits if y <= amounts[0][2] and k in ("lower", "upper")]
        if kinds and kinds[-1] == "lower":
            return values[0], None, currency, period, Decimal(1)
        if kinds and kinds[-1] == "upper" or re.match(r"\s*(?:to|bis)\b", before):
            return None, values[0], currency, period, Decimal(1)
        return values[0], values[0], currency, period, Decimal(1)


def currency_of(text: str, parser: PayParser) -> str:
    """Currency code of a typed currency column, or empty."""
    return next((v for *_, (k, v) in parser.automaton.find(text.lower().strip()) if k == "currency"), "")


def pay_facts(text, low, high, code, parser: PayParser, cache: dict) -> tuple:
    """(low, high, currency, period) of one record, amounts as text or None."""
    if (got := cache.get(text)) is None:
        got = cache[text] = parser(text) if text is not None else (None, None, "", "", Decimal(1))
    a, b, currency, period, factor = got
    if (typed := cache.get(("c", code))) is None:
        typed = cache[("c", code)] = currency_of(code, parser) if code is not None else ""
    if currency == "$":
        currency = typed if typed in DOLLARS else "USD"
    currency = currency or typed or "USD"
    currency = "USD" if currency == "$" else currency
    if a is None and b is None:
        if factor < 1 and currency in NO_MINOR:
            factor = Decimal(1)
        a = None if low is None else Decimal(repr(float(low))) * factor
        b = None if high is None else Decimal(repr(float(high))) * factor
    return (None if a is None else format(a, "f"), None if b is None else format(b, "f"), currency, period or "year")


#: Distinct texts one task keeps parsed.
CACHE = 200_000


def parsed_pay(rows: DataFrame, key: str = "id", text: str = "salary", low: str = "comp_min", high: str = "comp_max", code: str = "comp_currency") -> DataFrame:
    """(id, low, high, currency, pay_period): stated ends as decimals in whole units of the currency per period."""
    src = rows.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("t"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"), F.col(code).cast("string").alias("c"))
    src = src.where("t is not null or lo is not null or hi is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, cache = PayParser(), {}
        for b in batches:
            if len(cache) > CACHE:
                cache.clear()
            b = b.astype(object).where(b.notna(), None)
            got = [pay_facts(t, lo, hi, c, parser, cache) for t, lo, hi, c in zip(b["t"], b["lo"], b["hi"], b["c"])]
            out = pd.DataFrame(got, columns=["low", "high", "currency", "pay_period"])
            out.insert(0, "id", b["id"].to_numpy())
            yield out[out["low"].notna() | out["high"].notna()]

    return src.mapInPandas(parse, "id string, low string, high string, currency string, pay_period string")


def yearly_pay(rows: DataFrame, fx_rates: DataFrame, pay_units: DataFrame, **columns: str) -> DataFrame:
    """Distinct (id, usd_year_min, usd_year_max), rounded half up, the smaller end first, -1 for an end not stated."""
    fx = small_side(fx_rates.select("currency", F.col("usd_per_unit").cast("decimal(12,8)").alias("rate")).dropDuplicates(["currency"]))
    per = small_side(pay_units.select("pay_period", F.col("per_year").cast("decimal(6,0)").alias("per_year")).dropDuplicates(["pay_period"]))
    pay = parsed_pay(rows, **columns).join(fx, "currency").join(per, "pay_period")

    def usd(c: str):
        return F.round(F.col(c).try_cast("decimal(16,4)") * F.col("per_year") * F.col("rate"), 0).cast("bigint")

    ends = pay.select("id", usd("low").alias("a"), usd("high").alias("b")).where("a is not null or b is not null")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    low = F.when(both, F.least("a", "b")).otherwise(F.coalesce("a", F.lit(-1)))
    high = F.when(both, F.greatest("a", "b")).otherwise(F.coalesce("b", F.lit(-1)))
    return ends.select("id", low.alias("usd_year_min"), high.alias("usd_year_max")).distinct()
