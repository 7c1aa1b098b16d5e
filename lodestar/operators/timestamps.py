"""Mixed timestamp formats and zones to one UTC instant.

Each value is tokenised in the JVM into a mask of character classes (digit ``9``, letter run ``a``,
everything else itself). A batch maps each distinct mask to one parser, once; the parser works on all
values of that mask at a time with NumPy, and wall times go through versioned zone transition tables
(:mod:`lodestar.functions.zones`). Nothing is shuffled but the final distinct.

Defined results: a value from which no instant follows (null, empty, impossible date, vague words such
as "recently" or "30+ days ago") gives no row; a wall time without a zone on a platform without a known
zone gives no row; a span ("3 days ago") without a readable ``first_seen`` gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.zones import DAY, ZoneTables
from lodestar.session import bounded_rows, small_side

NONE = np.iinfo(np.int64).min
#: Seconds of a span's unit; a month is 30 days.
UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": DAY, "week": 7 * DAY, "month": 30 * DAY, "year": 365 * DAY}
#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Fields that state a time without a zone in UTC rather than in the platform's zone.
MAX_PLATFORMS = 100_000


def mask(c: Column) -> Column:
    """Character-class shape of a text: digits to 9, each run of letters to ``a``, space runs to one space."""
    s = F.regexp_replace(F.trim(c), r"\p{N}", "9")
    return F.regexp_replace(F.regexp_replace(s, r"\p{L}+", "a"), r"\s+", " ")


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates; ``NONE`` where there is no such date."""
    ok = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    ym = np.where(ok, (y - 1970) * 12 + (m - 1), 0)
    first = ym.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (ym + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    ok &= d <= length
    return np.where(ok, first + d - 1, NONE)


ISO = re.compile(
    r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?:(?:t|\s+|\s*,\s*)(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,]\d+)?)?\s*(?P<p>[ap]\.?m\.?)?)?\s*(?P<z>z|[a-z]{2,5}|[+-]\d{1,2}(?::?\d{2})?)?"
)
COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,]\d+)?\s*(?P<z>z|[a-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?")
ORDERED = re.compile(
    r"(?P<a>\d{1,2})[/.\-](?P<b>\d{1,2})[/.\-](?P<y>\d{4})(?:,?\s+(?:um\s+)?(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,]\d+)?)?\s*(?P<p>[ap]\.?m\.?)?)?\s*(?P<z>z|[a-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"
)
MONTH_FIRST = re.compile(
    r"(?P<mon>[a-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?:,?\s+(?:at\s+)?(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2}))?\s*(?P<p>[ap]\.?m\.?)?)?\s*(?P<z>z|[a-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"
)
DAY_FIRST = re.compile(
    r"(?:[a-z]{2,9}\.?,?\s+)?(?P<d>\d{1,2})(?:st|nd|rd|th)?\.?[\s-]+(?P<mon>[a-z]{3,9})\.?,?[\s-]+(?P<y>\d{4})(?:,?\s+(?:at\s+)?(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2}))?\s*(?P<p>[ap]\.?m\.?)?)?\s*(?P<z>z|[a-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?"
)
SPAN = re.compile(r"(?:(?:re)?posted\s+)?(?P<n>\d{1,6}|an?|one)\s+(?P<u>second|sec|minute|min|hour|hr|day|week|month|year)s?\s+ago")
WORD = re.compile(r"(?:(?:re)?posted\s+)?(?P<w>today|yesterday|just now|now)")
DIGITS = re.compile(r"(?P<n>\d{9,19})")
PARSERS = [("epoch", DIGITS), ("iso", ISO), ("compact", COMPACT), ("ordered", ORDERED), ("month_first", MONTH_FIRST), ("day_first", DAY_FIRST), ("span", SPAN), ("word", WORD)]


def parser_of(shape: str, example: str) -> tuple[str, re.Pattern] | None:
    """The parser for a mask. Masks without digits keep their words, so those are asked for each value."""
    return next(((k, r) for k, r in PARSERS if r.fullmatch(example)), None)


def _int(s: pd.Series | None, n: int, default: int = 0) -> np.ndarray:
    if s is None:
        return np.full(n, default, dtype=np.int64)
    return pd.to_numeric(s, errors="coerce").fillna(default).to_numpy().astype(np.int64)


def _offset_minutes(z: str, local: str | None) -> int | None:
    """Minutes of a written zone. Abbreviations that several regions use follow the platform's own zone."""
    if z[0] in "+-":
        d = z[1:].replace(":", "")
        h, m = (int(d), 0) if len(d) <= 2 else (int(d[:-2]), int(d[-2:]))
        return None if h > 15 or m > 59 else (-1 if z[0] == "-" else 1) * (h * 60 + m)
    if local:
        if z == "cst" and local in ("Asia/Shanghai", "Asia/Taipei"):
            return 480
        if z == "ist" and local == "Europe/Dublin":
            return 60
        if z == "ist" and local in ("Asia/Jerusalem", "Asia/Tel_Aviv"):
            return 120
        if z in ("est", "edt") and local.startswith("Australia/"):
            return 600 if z == "est" else 660
    return ABBREVIATIONS.get(z)


def _absolute(kind: str, regex: re.Pattern, v: pd.Series, zones: ZoneTables, tz: pd.Series, day_first: np.ndarray) -> np.ndarray:
    """UTC seconds of values one parser reads; ``tz`` is the zone of wall times without one."""
    n, out = len(v), np.full(len(v), NONE, dtype=np.int64)
    if kind == "epoch":
        raw = v.to_numpy()
        for i, s in enumerate(raw):
            x, k = int(s), len(s)
            out[i] = x // (1 if k <= 11 else 10**3 if k <= 14 else 10**6 if k <= 17 else 10**9)
        return out
    x = v.str.extract(f"^(?:{regex.pattern})$")
    y, d = _int(x["y"], n), None
    if kind == "ordered":
        a, b = _int(x["a"], n), _int(x["b"], n)
        first = day_first.copy()
        first = np.where((b > 12) & (a <= 12), False, np.where((a > 12) & (b <= 12), True, first))
        d, m = np.where(first, a, b), np.where(first, b, a)
    elif "mon" in x:
        d, m = _int(x["d"], n), x["mon"].str[:3].map(MONTHS).fillna(0).to_numpy().astype(np.int64)
    else:
        d, m = _int(x["d"], n), _int(x["m"], n)
    day = days_from_civil(y, m, d)
    H, M, S = (_int(x[k] if k in x else None, n) for k in "HMS")
    ok = day != NONE
    if "p" in x:
        half = x["p"].notna().to_numpy()
        pm = x["p"].fillna("").str.startswith("p").to_numpy()
        ok &= ~half | ((H >= 1) & (H <= 12))
        H = np.where(half, H % 12 + np.where(pm, 12, 0), H)
    ok &= (H <= 23) & (M <= 59) & (S <= 60)
    wall = np.where(ok, np.where(ok, day, 0) * DAY + H * 3600 + M * 60 + S, NONE)
    z = x["z"] if "z" in x else pd.Series([None] * n, index=v.index)
    written = z.notna().to_numpy()
    key = pd.Series(np.where(written, z.fillna("").astype(str) + "|" + tz.fillna("").astype(str), ""), index=v.index)
    for k in pd.unique(key[written & ok]):
        name, _, local = k.partition("|")
        off = _offset_minutes(name, local or None)
        sel = (key == k).to_numpy() & ok
        if off is not None:
            out[sel] = wall[sel] - off * 60
    for name in pd.unique(tz[~written & ok]):
        sel = (tz == name).to_numpy() & ~written & ok
        if name in zones.tables:
            out[sel] = zones.tables[name].to_utc(wall[sel])
    return out


def parse_instants(values: pd.Series, masks: pd.Series, zones: ZoneTables, tz: pd.Series, day_first: np.ndarray, base: np.ndarray | None = None, day_zone: pd.Series | None = None) -> np.ndarray:
    """UTC seconds of texts (``NONE`` where none follows). ``base``: instants that spans and day words refer to; ``day_zone``: the zone whose days "today" means."""
    v = values.fillna("").str.strip().str.lower().str.replace(r"\s+", " ", regex=True)
    out = np.full(len(v), NONE, dtype=np.int64)
    worded = ~masks.fillna("").str.contains("9")
    key = masks.fillna("").where(~worded, "w:" + v)
    first = ~key.duplicated()
    chosen = {k: parser_of(k, example) for k, example in zip(key[first], v[first])}
    # a mask whose first value no parser reads (odd words between the digits) is asked again, once for each other value
    again = key.isin([k for k, c in chosen.items() if c is None]) & ~pd.Series(list(zip(key, v)), index=key.index, dtype=object).duplicated()
    for k, example in zip(key[again], v[again]):
        if chosen[k] is None:
            chosen[k] = parser_of(k, example)
    kinds = key.map({k: c[0] if c else "" for k, c in chosen.items()})
    for kind, regex in PARSERS:
        sel = (kinds == kind).to_numpy()
        if not sel.any():
            continue
        sub = v[sel]
        if kind in ("span", "word"):
            if base is None:
                continue
            x = sub.str.extract(f"^(?:{regex.pattern})$")
            b = base[sel]
            ok = b != NONE
            b = np.where(ok, b, 0)
            if kind == "span":
                num = pd.to_numeric(x["n"].where(~x["n"].isin(["a", "an", "one"]), "1"), errors="coerce")
                secs = x["u"].map(UNITS)
                good = ok & num.notna().to_numpy() & secs.notna().to_numpy()
                out[sel] = np.where(good, b - (num.fillna(0) * secs.fillna(0)).to_numpy().astype(np.int64), NONE)
            else:
                w, z = x["w"].fillna("").to_numpy(), (day_zone if day_zone is not None else tz)[sel]
                res = np.where(ok & np.isin(w, ["now", "just now"]), b, NONE)
                for name in pd.unique(z.dropna()):
                    s = (z == name).to_numpy() & ok & np.isin(w, ["today", "yesterday"])
                    if name in zones.tables and s.any():
                        t = zones.tables[name]
                        day = t.to_wall(b[s]) // DAY - (w[s] == "yesterday")
                        res[s] = t.to_utc(day * DAY)
                out[sel] = res
        else:
            out[sel] = _absolute(kind, regex, sub, zones, tz[sel], day_first[sel])
    return out


def normalize_timestamps(rows: DataFrame, platforms: DataFrame, key: str = "id", wall_field: str = "posted_at", utc_field: str = "first_seen", platform: str = "platform") -> DataFrame:
    """Distinct (key, field_name, utc_seconds) of two text columns.

    ``utc_field`` without a zone is in UTC; ``wall_field`` without a zone is in the platform's zone, its
    spans and day words refer to the row's ``utc_field``. ``platforms`` has platform, tz_name, day_first.
    """
    spark = rows.sparkSession
    p = platforms.select(F.col("platform").alias("__platform"), F.col("tz_name").alias("__tz"), F.col("day_first").alias("__day_first")).dropDuplicates(["__platform"])
    names = [r[0] for r in bounded_rows(p.select("__tz").distinct(), MAX_PLATFORMS, "platform zones")]
    zones = ZoneTables.load([*names, "UTC"])
    src = rows.select(F.col(key).cast("string").alias("k"), F.col(platform).alias("__platform"), F.col(wall_field).cast("string").alias("w"), F.col(utc_field).cast("string").alias("u"))
    src = src.where("w is not null or u is not null").join(small_side(p), "__platform", "left").select("k", "w", "u", mask(F.col("w")).alias("wm"), mask(F.col("u")).alias("um"), "__tz", F.coalesce("__day_first", F.lit(False)).alias("df"))

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            utc = pd.Series(["UTC"] * len(b))
            df = b["df"].to_numpy().astype(bool)
            base = parse_instants(b["u"], b["um"], zones, utc, df)
            posted = parse_instants(b["w"], b["wm"], zones, b["__tz"], df, base, b["__tz"])
            for name, secs in ((utc_field, base), (wall_field, posted)):
                ok = secs != NONE
                yield pd.DataFrame({"id": b["k"][ok], "field_name": name, "utc_seconds": secs[ok]})

    return src.mapInPandas(convert, "id string, field_name string, utc_seconds bigint").distinct()


def mask_profile(rows: DataFrame, column: str) -> DataFrame:
    """(mask, values): how often each shape occurs, most frequent first: what a new source writes."""
    return rows.where(F.col(column).isNotNull()).groupBy(mask(F.col(column)).alias("mask")).agg(F.count("*").alias("values"))


def unknown_zones(rows: DataFrame, platforms: DataFrame, platform: str = "platform", wall_field: str = "posted_at") -> DataFrame:
    """(platform, tz_name, values): values of platforms whose zone is missing or not in the database; those without a zone of their own state no instant."""
    p = platforms.select("platform", "tz_name").dropDuplicates(["platform"])
    known = set(ZoneTables.load([r[0] for r in bounded_rows(p.select("tz_name").distinct(), MAX_PLATFORMS, "platform zones")]).tables)
    x = rows.where(F.col(wall_field).isNotNull()).groupBy(F.col(platform).alias("platform")).agg(F.count("*").alias("values"))
    return x.join(small_side(p), "platform", "left").where(F.col("tz_name").isNull() | ~F.col("tz_name").isin(sorted(known))).select("platform", "tz_name", "values")
