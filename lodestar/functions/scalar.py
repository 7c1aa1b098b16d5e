"""Scalar rules as Columns; Python only where no built-in expresses the rule, then as Arrow-batched functions."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import unicodedata
import urllib.parse
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# What the vocabularies and patterns must hold for equal results.
NYC = r"(?i)\b(new york|nyc|manhattan|brooklyn|queens|bronx|staten island)\b"
REMOTE = r"(?i)\bremote\b"
SENIOR = r"(?i)\b(senior|sr\.?|staff|principal|director|vp\b|vice president|head of|lead\b|chief|executive|manager)\b"
ENTRY = r"(?i)\b(entry.?level|junior|jr\.?|new grad|graduate|intern(ship)?|apprentice|associate|coordinator)\b"
TRACKING = re.compile(r"^(utm_|gclid|fbclid|ref|source$)", re.I)
SENIORITY = ("intern", "new_grad", "junior", "mid", "senior", "staff", "principal", "director", "exec")
EMPLOYMENT_TYPE = ("full_time", "part_time", "contract", "internship", "unknown")
REMOTE_POLICY = ("onsite", "hybrid", "remote_local", "remote_anywhere", "unknown")


def stable_id(*parts: Column, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of the parts joined by colons; a null is the text ``None``."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, length)


def content_hash(parts: Sequence[Column], blank: Sequence[Column] = ()) -> Column:
    """SHA-256 of the parts joined by bars; nulls of ``blank`` parts are empty, other nulls the text ``None``."""
    given = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts] + [F.coalesce(p.cast("string"), F.lit("")) for p in blank]
    return F.sha2(F.concat_ws("|", *given), 256)


def python_bool(c: Column) -> Column:
    """True or False as Python prints them."""
    return F.initcap(c.cast("string"))


def slugify(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def guess_seniority(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").when(c.rlike(SENIOR), "senior").when(c.rlike(ENTRY), "entry").otherwise("mid_or_unspecified")


def classify_location(c: Column) -> tuple[Column, Column]:
    t = F.coalesce(c, F.lit(""))
    return t.rlike(NYC), t.rlike(REMOTE)


def location_flags(text: Column, remote_type: Column) -> tuple[Column, Column]:
    """(in the city, remote), where the first is null if the text can't say: absent, "2 Locations", or not shaped like a place."""
    remote = F.coalesce(remote_type.rlike("(?i)remote"), F.lit(False))
    many = text.isNull() | (text == "") | text.rlike(r"(?i)^\s*\d+\s+locations?\s*$")
    nyc, said = text.rlike(NYC), text.rlike(REMOTE)
    place = text.rlike(r",\s*[A-Za-z]{2,}")
    is_remote = said | remote
    return F.when(many, F.lit(None).cast("boolean")).when(~nyc & ~is_remote & ~place, F.lit(None).cast("boolean")).otherwise(nyc), F.when(many, F.when(remote, True)).otherwise(is_remote)


def merge_tristate(a: Column, b: Column) -> Column:
    """True if either is, false if either says so, else null."""
    yes = F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    return F.when(yes, True).when(a.isNotNull() | b.isNotNull(), False)


def closed(c: Column, allowed: Sequence[str], default: str | None = None) -> Column:
    """A typed answer on a closed vocabulary: exact, else the first entry that begins it or equals it without separators."""
    v = F.regexp_replace(F.lower(F.trim(c)), "[- /]", "_")
    out = F.lit(default).cast("string")
    for a in reversed(allowed):
        out = F.when(F.startswith(v, F.lit(a + "_")) | (v == a.replace("_", "")), a).otherwise(out)
    return F.when(v.isin(*allowed), v).otherwise(out)


def first_of_tokens(c: Column, allowed: Sequence[str]) -> Column:
    """A typed answer by its words without ``and``: equal, joined, or the words a longer entry begins with."""
    words = F.filter(F.split(F.lower(F.trim(c)), "[^a-z0-9]+"), lambda w: (w != "") & (w != "and"))
    key = F.array_join(words, "_")
    out = F.lit(None).cast("string")
    for a in reversed(allowed):
        plain = "_".join(w for w in a.split("_") if w != "and")
        out = F.when((key == plain) | (F.array_join(words, "") == plain.replace("_", "")) | ((F.size(words) > 1) & F.startswith(F.lit(plain), F.concat(key, F.lit("_")))), a).otherwise(out)
    return out


def normalized_title(c: Column, noise: Sequence[str]) -> Column:
    """A title without asides, punctuation and noise words."""
    t = F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "–—", "  "), r"\(.*?\)", " "), "[^a-z0-9 ]", " ")
    return F.array_join(F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(*noise)), " ")


def salary_text(text: Column, low: Column, high: Column, currency: Column) -> Column:
    """The stored text, else "CUR low-high"; null without a currency or an amount."""
    return F.coalesce(text, F.concat(currency, F.lit(" "), F.nullif(F.concat_ws("-", low.cast("bigint").cast("string"), high.cast("bigint").cast("string")), F.lit(""))))


def comp_label(low: Column, high: Column, text: Column) -> Column:
    """Both ends, "From", "Up to", or the stored text."""
    def n(c: Column) -> Column:
        return F.format_number(c, 0)

    return F.when(low.isNotNull() & high.isNotNull(), F.concat(n(low), F.lit(" – "), n(high))).when(low.isNotNull(), F.concat(F.lit("From "), n(low))).when(high.isNotNull(), F.concat(F.lit("Up to "), n(high))).otherwise(text)


def length_error(text: Column, most: int) -> Column:
    """Code of what is wrong with a search text, or null."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(F.length(text) > most, "too_long")


def segment_score(c: Column) -> Column:
    """How much a header field looks like a role: positive words count for it, places, pay, terms and addresses against it."""
    def sign(pattern: str, points: int) -> Column:
        return F.when(c.rlike(pattern), points).otherwise(0)

    rules = [
        (r"(?i)\b(engineer|developer|analyst|designer|manager|scientist|recruiter|administrator|nurse|specialist|consultant|coordinator)\b", 3),
        (f"{NYC}|{REMOTE}", -2),
        (r"(?i)\b(onsite|hybrid)\b|, [A-Z]{2}\b", -2),
        (r"[$€£]\s?\d|\d+k\b", -3),
        (r"(?i)\b(full.?time|part.?time|contract|intern)\b", -2),
        (r"https?://|\b\w+\.(com|io|org)\b", -4),
    ]
    return reduce(lambda a, b: a + b, [sign(p, n) for p, n in rules], F.when(F.length(c) > 100, -3).otherwise(0))


#: Seconds of 2000-01-01 UTC; smaller epochs are missing fields rather than times. Fixed value.
LEAST_EPOCH = 946_684_800


def to_utc(text: Column, zone: str = "America/New_York") -> Column:
    """UTC instant of epoch seconds, an ISO date or an ISO time; without an offset it is the wall time of ``zone``. Null otherwise."""
    t = F.trim(text)
    t = F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d)(?=$|Z|[+-])", "$1:00")
    wall = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?$"), F.concat(t, F.lit("Z")))
    stated = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"), t)
    epoch = F.when(t.rlike(r"^\d{1,12}$"), t.cast("bigint"))
    return F.when(epoch >= LEAST_EPOCH, F.timestamp_seconds(epoch)).otherwise(F.coalesce(stated.try_cast("timestamp"), F.to_utc_timestamp(wall.try_cast("timestamp"), zone)))


def posting_age(posted: Column, first_seen: Column, now: Column) -> tuple[Column, Column]:
    """(days, exact): whole days since it was posted, else since it was first seen, which is an upper bound; never below 0."""
    at, seen = to_utc(posted, "UTC"), to_utc(first_seen, "UTC")
    secs = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(at, seen))
    return F.when(secs.isNotNull(), F.greatest(F.lit(0), F.floor(secs / 86400))), at.isNotNull()


#: How a page names a board: platform, pattern, whether a site follows the token. Fixed values.
BOARDS = (
    ("greenhouse", r"(?i)(?:boards|job-boards|boards-api)\.greenhouse\.io/(?!embed\b)([A-Za-z0-9_.-]{2,})", False),
    ("greenhouse", r"(?i)greenhouse\.io/embed/job_board[^\s\"']*?[?&](?:amp;)?for=([A-Za-z0-9_.-]{2,})", False),
    ("lever", r"(?i)jobs\.(?:eu\.)?lever\.co/([A-Za-z0-9_.-]{2,})", False),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([A-Za-z0-9_.-]{2,})", False),
    ("workable", r"(?i)apply\.workable\.com/([A-Za-z0-9_-]{2,})", False),
    ("recruitee", r"(?i)([A-Za-z0-9_-]{2,})\.recruitee\.com", False),
    ("smartrecruiters", r"(?i)(?:careers|jobs)\.smartrecruiters\.com/([A-Za-z0-9_-]{2,})", False),
    ("workday", r"(?i)([A-Za-z0-9_-]{2,})\.wd\d+\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]{2,})", True),
    ("bamboohr", r"(?i)([A-Za-z0-9_-]{2,})\.bamboohr\.com/(?:careers|jobs)", False),
)


def board_signatures(page: Column) -> Column:
    """Array of (platform, token, site) of the boards a page names, each once whatever its case, in order of platform and token."""

    def named(platform: str, pattern: str, sited: bool) -> Column:
        tokens = F.regexp_extract_all(page, F.lit(pattern), F.lit(1))
        sites = F.regexp_extract_all(page, F.lit(pattern), F.lit(2)) if sited else F.transform(tokens, lambda t: F.lit(""))
        return F.zip_with(tokens, sites, lambda t, s: F.struct(F.lit(platform).alias("platform"), F.btrim(t, F.lit(".-")).alias("token"), s.alias("site")))

    rows = F.filter(F.array_sort(F.concat(*[named(*b) for b in BOARDS])), lambda x: F.length(x["token"]) >= 2)
    same = lambda x, y: (x["platform"] == y["platform"]) & (F.lower(x["token"]) == F.lower(y["token"])) & (F.lower(x["site"]) == F.lower(y["site"]))
    return F.aggregate(rows, F.slice(rows, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.array_append(acc, x)))


def date_chip(last_run: Column, now: Column) -> Column:
    """today, 3days, week or month by the time since the last run; null if it never ran."""
    secs = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(last_run, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(secs.isNull(), F.lit(None).cast("string")).when(secs <= 86400, "today").when(secs <= 3 * 86400, "3days").when(secs <= 7 * 86400, "week").otherwise("month")


def relative_instant(text: Column, now: Column) -> Column:
    """Instant of "3 days ago" and the like before ``now``; day words are midnights; null otherwise."""
    p = r"(?i)(?:(\d+)\+?|\b(?:an?)\b)\s*(minute|hour|day|week|month)s?\s*ago"
    n = F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int"), F.lit(1))
    unit = F.lower(F.regexp_extract(text, p, 2))
    secs = n * F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800).when(unit == "month", 2592000)
    midnight = F.date_trunc("day", now)
    by_word = F.when(text.rlike(r"(?i)\byesterday\b"), midnight - F.expr("interval 1 day")).when(text.rlike(r"(?i)\btoday\b"), midnight)
    return F.when(secs.isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) - secs)).otherwise(by_word)


def cycle_bounds(day: Column, reset_day: int) -> tuple[Column, Column]:
    """First day of the billing cycle of a date and of the next one; the reset day is clamped to short months."""
    def reset(month: Column) -> Column:
        return F.date_add(month, F.least(F.lit(reset_day), F.dayofmonth(F.last_day(month))) - 1)

    month = F.trunc(day, "month")
    this = reset(month)
    start = F.when(day >= this, this).otherwise(reset(F.add_months(month, -1)))
    return start, F.when(day >= this, reset(F.add_months(month, 1))).otherwise(this)


def run_allowance(left: Column, days_left: Column, reserve: int = 0) -> Column:
    """Runs to spend today: at least one while any are left, none when spent, null when unknown."""
    return F.when(left.isNull() | days_left.isNull(), F.lit(None).cast("bigint")).when(left <= reserve, 0).otherwise(F.greatest(F.lit(1), F.floor((left - reserve) / days_left)))


def tolerant_json(c: Column) -> Column:
    """JSON text of an answer: code fences dropped, from the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))


def clamp_score(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c, 0))).cast("int")


def int_in_range(c: Column, low: int, high: int) -> Column:
    """A number from text within a range, else null; decimals are cut."""
    n = c.try_cast("double").try_cast("bigint")
    return F.when(n.between(low, high), n)


# rules without a built-in: Arrow batches


@F.pandas_udf(StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """One posting, one URL: no tracking parameters, sorted query, no fragment, no trailing slash."""

    def one(url):
        if not url:
            return ""
        try:
            u = urllib.parse.urlsplit(url)
        except ValueError:
            return url
        query = sorted((k, v) for k, v in urllib.parse.parse_qsl(u.query) if not TRACKING.match(k))
        return u._replace(path=u.path.rstrip("/"), query=urllib.parse.urlencode(query), fragment="").geturl()

    return urls.map(one)


@F.pandas_udf(StringType())
def search_source_id(blobs: pd.Series, tokens: pd.Series, titles: pd.Series, urls: pd.Series) -> pd.Series:
    """The id inside a base64 JSON blob, else a fingerprint of token, title and (normalised) address."""

    def one(blob, token, title, url):
        try:
            got = json.loads(base64.b64decode(blob + "=" * (-len(blob) % 4))) if blob else None
        except ValueError:
            got = None
        if isinstance(got, dict) and got.get("htidocid"):
            return str(got["htidocid"])
        key = "|".join((token or "", " ".join((title or "").lower().split()), url or ""))
        return "fp:" + hashlib.sha256(key.encode()).hexdigest()[:16]

    return pd.Series([one(*x) for x in zip(blobs, tokens, titles, urls)], index=blobs.index)


#: A tag: double-quoted attribute values hide ">" as long as they hold no "<"; else up to the next ">". Fixed value.
TAG = re.compile(r'<(?:"[^"<]*"|[^<>"])+>|<[^>]+>')


@F.pandas_udf(StringType())
def unescape_html(markup: pd.Series) -> pd.Series:
    """Markup with its character references resolved, one level."""
    return markup.map(html.unescape, na_action="ignore")


def strip_html(markup: Column | str, limit: int | None = None) -> Column:
    """Readable text of markup whose references are resolved exactly once, white space collapsed; null if nothing is left.

    ``limit`` keeps the first so many characters (for display); without it texts stay whole.
    """

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(m):
            t = re.sub(r"\s+", " ", TAG.sub(" ", html.unescape(m))).strip()
            return (t if limit is None else t[:limit]) or None

        return texts.map(one, na_action="ignore")

    return run(markup)


@F.pandas_udf(StringType())
def search_key(raw: pd.Series) -> pd.Series:
    """Search text to compare by: no accents, case folded, letters, digits, ``+`` and ``#`` only."""

    def one(t):
        if t is None:
            return None
        d = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        f = unicodedata.normalize("NFC", d).casefold()
        return " ".join("".join(c if c.isalnum() or c in "+#" else " " for c in f).split())

    return raw.map(one, na_action="ignore")


def bounded_json(limit: int, long_field: str):
    """A function that keeps JSON objects valid and at most ``limit`` characters long: their long field is cut; if that is
    not enough, or the text is no object, a marker with the original length takes its place. Texts within the limit stay as they are."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def fitting(obj: dict, most: int) -> str | None:
            """The object with the longest beginning of the field that fits: escapes make lengths uneven, so it is searched for."""
            value, lo, hi = obj[long_field], -1, len(obj[long_field])
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if len(json.dumps({**obj, long_field: value[:mid]})) <= most:
                    lo = mid
                else:
                    hi = mid - 1
            return json.dumps({**obj, long_field: value[:lo]}) if lo >= 0 else None

        def one(t):
            if t is None or len(t) <= limit:
                return t
            try:
                obj = json.loads(t)
            except ValueError:
                obj = None
            cut = fitting(obj, limit) if isinstance(obj, dict) and isinstance(obj.get(long_field), str) else None
            return cut or json.dumps({"_truncated": True, "_original_chars": len(t)})

        return texts.map(one, na_action="ignore")

    return run


def path_present(path: str):
    """A function that says whether a dotted path leads to a value in JSON, through lists and objects."""

    @F.pandas_udf(BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        def walk(node, keys):
            if isinstance(node, list):
                return any(walk(x, keys) for x in node)
            if not keys:
                return node not in (None, "", [], {})
            return isinstance(node, dict) and keys[0] in node and walk(node[keys[0]], keys[1:])

        def one(t):
            try:
                return bool(walk(json.loads(t), path.split(".")))
            except (ValueError, TypeError):
                return False

        return texts.map(one)

    return run
