"""Free-entered values to the entries of a canonical list.

One automaton over all canonical names and aliases finds embedded mentions in a typed value; the longest
non-overlapping mention wins. Values without a mention go to token-set similarity: typed tokens are
compared with each entry's tokens by edit distance, in any order, and the closest entry is taken when it
is close enough and no other entry is as close. Everything else is reported as unmatched (-1).

Each executor task holds the compiled list (its size is checked) and a cache of values already mapped, so
a frequent value is worked out once per task and no row is shuffled. Which names belong to one entry only is
decided over the whole list; above ``MAX_ENTRIES`` entries the names are worked through in blocks over the distinct
values, each block gives its longest mention and its two closest entries, and one rule decides over all of them, so
the answer is that of the whole list at once.

Defined results: null values are no cases; empty and symbol-only values are -1; a name that belongs
to several entries ("Portland") is -1 unless the rest of the value decides; of equally long mentions the
earlier one counts; two entries that are equally close give -1.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.automaton import AliasAutomaton
from lodestar.session import is_small, materialize

#: Entries compiled at once; a longer list is processed in blocks of this many.
MAX_ENTRIES = 50_000
#: Least token-set similarity, least similarity of one token, and least lead over the next entry.
THRESHOLD, TOKEN_FLOOR, LEAD = 0.75, 0.5, 0.02
#: Distinct values one task keeps mapped.
CACHE = 100_000

#: Postal codes of regions, for "City, CA" written "City, California". Fixed values.
REGIONS = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "dc": "district of columbia", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "ia": "iowa", "id": "idaho", "il": "illinois", "in": "indiana", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "ma": "massachusetts", "md": "maryland", "me": "maine", "mi": "michigan", "mn": "minnesota", "mo": "missouri", "ms": "mississippi", "mt": "montana", "nc": "north carolina", "nd": "north dakota", "ne": "nebraska", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "nv": "nevada", "ny": "new york", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "va": "virginia", "vt": "vermont", "wa": "washington", "wi": "wisconsin", "wv": "west virginia", "wy": "wyoming",
}


@dataclass(frozen=True)
class Vocabulary:
    """What is known of the fields beside the list: other names of an entry, words that say nothing about which entry
    is meant, and the fields whose values read "head, tail", where the head alone names an entry if it is the only one."""

    synonyms: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    noise: dict[str, set[str]] = field(default_factory=dict)
    headed: frozenset[str] = frozenset()
    squeezed: frozenset[str] = frozenset()


#: Other words for a name, by field: what the list's own alt_names leave out.
SYNONYMS = {
    "seniority_level": {
        "intern": ["internship", "trainee"], "new_grad": ["new graduate", "recent graduate", "recent grad", "newgrad", "graduate", "entry level"], "junior": ["jr", "jnr"], "mid": ["midlevel", "mid level", "intermediate", "middle"],
        "senior": ["sr", "snr"], "principal": ["princ", "principle"], "director": ["dir"], "exec": ["executive", "c level", "c level exec"],
    },
}
#: Words around a name that say nothing about which entry is meant, by field.
NOISE = {
    "location_raw": set("us usa u s hq hybrid onsite on site office area greater metro remote only".split()) - {"remote"},
    "department": set("dept department team group division global us usa of the and unit function org".split()),
    "seniority_level": set("level lvl ic grade career yrs years team role the".split()),
}
#: The vocabulary of job postings.
POSTINGS = Vocabulary(SYNONYMS, NOISE, frozenset({"location_raw"}), frozenset({"seniority_level"}))


def fold(text: str) -> str:
    """Lower case, without accents and punctuation, single spaces."""
    t = unicodedata.normalize("NFKD", text.casefold())
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"(?<=\w)'s\b", "", t).replace("&", " and ")
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFC", t)).strip()


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edits with neighbour swaps as one (optimal string alignment); more than ``limit`` is ``limit + 1``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            new.append(c)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def similarity(a: str, b: str, floor: float = 0.0) -> float:
    """1 minus edits over the longer length; 0 below ``floor``."""
    n = max(len(a), len(b))
    if not n:
        return 0.0
    limit = int((1 - floor) * n)
    d = edit_distance(a, b, limit)
    return 0.0 if d > limit else 1 - d / n


def entry_names(ref_field: str, value: str, alt_names: str | None, words: Vocabulary) -> tuple[list[str], list[str]]:
    """Folded names of one entry: those that name it alone, and bare heads that count only if one entry has them."""
    sure, bare = [fold(value)], []
    head, comma, tail = value.partition(",")
    if ref_field in words.headed and comma:
        h, t = fold(head), fold(tail)
        tails = [t] + ([REGIONS[t]] if t in REGIONS else [])
        for x in tails:
            sure += [f"{h} {x}", f"{x} {h}"]
        bare.append(h)
    sure += [fold(a) for a in (alt_names or "").split("|")]
    sure += [fold(s) for s in words.synonyms.get(ref_field, {}).get(value, [])]
    sure.append(fold(value).replace(" ", "") if ref_field in words.squeezed else "")
    return [x for x in dict.fromkeys(sure) if x], bare


def own_names(entries: list[tuple[int, str, str | None]], ref_field: str, words: Vocabulary) -> list[tuple[str, int]]:
    """(name, entry) of the names that belong to one entry only."""
    owners: dict[str, set[int]] = defaultdict(set)
    bare: dict[str, set[int]] = defaultdict(set)
    for ref, value, alts in entries:
        sure, heads = entry_names(ref_field, value, alts, words)
        for n in sure:
            owners[n].add(ref)
        for h in heads:
            bare[h].add(ref)
    for h, refs in bare.items():
        if h not in owners and len(refs) == 1:
            owners[h] |= refs
    return sorted((n, min(r)) for n, r in owners.items() if len(r) == 1)


@dataclass
class Matcher:
    """Compiled names of one field, or of a block of them."""

    names: list[tuple[str, int]]
    noise: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.automaton = AliasAutomaton(dict(self.names))
        self.names = sorted((n for n in self.names if len(n[0].replace(" ", "")) >= 3), key=lambda n: (len(n[0].replace(" ", "")), n))
        self.squashed = ["".join(sorted_tokens(n)) for n, _ in self.names]
        self.plain = [n.replace(" ", "") for n, _ in self.names]
        self.lengths = np.array([len(x) for x in self.plain])
        self.counts = np.array([char_counts(x) for x in self.plain], dtype=np.int32).reshape(len(self.plain), 40)

    def mention(self, folded: str) -> tuple[int, int, int] | None:
        """(length, minus start, entry) of the longest mention; the earlier one of equally long mentions."""
        hits = self.automaton.find(folded)
        return max(((b - a, -a, ref) for a, b, _, ref in hits), default=None)

    def closest(self, folded: str) -> list[tuple[float, int]]:
        """(similarity, entry) of the two closest entries by token sets, as far as they are close enough."""
        tokens = [t for t in folded.split() if t not in self.noise] or folded.split()
        joined, ordered = "".join(tokens), "".join(sorted(tokens))
        if len(joined) < 3 or not self.names:
            return []
        most = 2 * max(1, len(joined) * (1 - THRESHOLD) + 1)
        lo, hi = np.searchsorted(self.lengths, [len(joined) - most, len(joined) + most + 1])
        near = lo + np.flatnonzero(np.abs(self.counts[lo:hi] - char_counts(joined)).sum(axis=1) <= most)
        best: dict[int, float] = {}
        for i in near:
            name, ref = self.names[i]
            s = max(similarity(joined, self.plain[i], THRESHOLD), similarity(ordered, self.squashed[i], THRESHOLD), token_set(tokens, name.split()))
            if s >= THRESHOLD and s > best.get(ref, 0.0):
                best[ref] = s
        return sorted(((s, r) for r, s in best.items()), key=lambda x: (-x[0], x[1]))[:2]

    def answers(self, value: str) -> list[tuple[int, float, int, int]]:
        """(rank, score, minus start, entry): the best mention, behind a colon (rank 3) or anywhere (2), else the closest two (1)."""
        # what follows a colon states the value ("mid-senior: mid")
        for part, rank in ([(value.rsplit(":", 1)[1], 3)] if ":" in value else []) + [(value, 2)]:
            folded = fold(part)
            if folded and (got := self.mention(folded)) is not None:
                return [(rank, float(got[0]), got[1], got[2])]
        return [(1, s, 0, ref) for s, ref in self.closest(fold(value))]


def decided(answers: list[tuple[int, float, int, int]]) -> tuple[int, float]:
    """(entry or -1, score) over the answers of all blocks; the score is over 2 for mentions, else the similarity."""
    if not answers:
        return -1, 0.0
    top = max(answers, key=lambda a: a[:3])
    if top[0] > 1:
        return top[3], top[0] + top[1] / 1e6
    if any(a[3] != top[3] and top[1] - a[1] < LEAD for a in answers):
        return -1, 0.0
    return top[3], top[1]


def sorted_tokens(name: str) -> list[str]:
    return sorted(name.split())


def token_set(a: list[str], b: list[str]) -> float:
    """Mean similarity of two token sets, each token paired with its closest; 0 if one finds none."""
    if not a or not b or len(a) != len(b):
        return 0.0
    total = 0.0
    for x in b:
        s = max(similarity(x, y, TOKEN_FLOOR) for y in a)
        if s == 0.0:
            return 0.0
        total += s * len(x)
    return total / sum(map(len, b))


def char_counts(text: str) -> np.ndarray:
    """How often each of 40 character classes occurs."""
    out = np.zeros(40, dtype=np.int32)
    for c in text:
        out[ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 14] += 1
    return out


_NAMES = list[tuple[str, str, int]]


def _cached(names: _NAMES, words: Vocabulary, last: Callable) -> Callable:
    """A function of (field, value) over compiled names that remembers its results."""
    matchers = {f: Matcher([(n, r) for g, n, r in names if g == f], words.noise.get(f, set())) for f in {n[0] for n in names}}
    cache: dict[tuple[str, str], object] = {}

    def get(f: str, v: str):
        if len(cache) > CACHE:
            cache.clear()
        if (r := cache.get((f, v))) is None:
            m = matchers.get(f)
            r = cache[f, v] = last(m.answers(v) if m else [])
        return r

    return get


def _mapped(values: DataFrame, names: _NAMES, words: Vocabulary) -> DataFrame:
    """(id, field_name, value, ref_id, score) of typed values against all names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _cached(names, words, decided)
        for b in batches:
            got = [get(f, v) for f, v in zip(b["field_name"], b["value"])]
            yield pd.DataFrame({"id": b["id"], "field_name": b["field_name"], "value": b["value"], "ref_id": [r[0] for r in got], "score": [r[1] for r in got]})

    return values.select("id", "field_name", "value").mapInPandas(run, "id string, field_name string, value string, ref_id int, score double")


def _answered(distinct: DataFrame, names: _NAMES, words: Vocabulary) -> DataFrame:
    """(field_name, value, rank, score, start, ref_id): a block's answers to distinct values."""
    columns = ["field_name", "value", "rank", "score", "start", "ref_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _cached(names, words, list)
        for b in batches:
            yield pd.DataFrame([(f, v, *a) for f, v in zip(b["field_name"], b["value"]) for a in get(f, v)], columns=columns)

    return distinct.mapInPandas(run, "field_name string, value string, rank int, score double, start int, ref_id int")


def map_values(values: DataFrame, canonical: DataFrame, words: Vocabulary = POSTINGS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(id, field_name, value, ref_id, score) for each non-null value of (id, field_name, value); -1 is unmatched."""
    values = values.where(F.col("value").isNotNull())
    ref = canonical.select(F.col("ref_id").cast("int").alias("ref_id"), "ref_field", "ref_value", "alt_names").where("ref_id is not null and ref_field is not null and ref_value is not null")
    if is_small(ref, max_entries):
        entries: dict[str, list] = defaultdict(list)
        for r in ref.collect():
            entries[r.ref_field].append((r.ref_id, r.ref_value, r.alt_names))
        return _mapped(values, [(f, n, i) for f, e in entries.items() for n, i in own_names(e, f, words)], words)

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, n, i, k) for i, f, v, a in zip(b["ref_id"], b["ref_field"], b["ref_value"], b["alt_names"]) for k, ns in enumerate(entry_names(f, v, a, words)) for n in ns]
            yield pd.DataFrame(rows, columns=["f", "n", "i", "bare"])

    owners = ref.mapInPandas(spelled, "f string, n string, i int, bare int").where("n <> ''").groupBy("f", "n", "bare").agg(F.min("i").alias("i"), F.max("i").alias("hi"))
    # a name some entry owns outright hides bare heads of the same spelling
    own = owners.groupBy("f", "n").agg(F.min(F.struct("bare", "i", "hi")).alias("x")).where("x.i = x.hi").select("f", "n", F.col("x.i").alias("i"))
    blocks = max(1, -(-ref.count() // max_entries) * 2)
    own = materialize(own.withColumn("block", F.pmod(F.xxhash64("f", "n"), F.lit(blocks))), "names")
    distinct = values.select("field_name", "value").distinct()
    found = None
    for i in range(blocks):
        part = _answered(distinct, [tuple(r) for r in own.where(F.col("block") == i).select("f", "n", "i").collect()], words)
        found = part if found is None else found.unionByName(part)
    top = F.struct("rank", "score", "start", "ref_id")
    per_entry = found.groupBy("field_name", "value", "ref_id").agg(F.max(F.struct("rank", "score", "start")).alias("x")).select("field_name", "value", "ref_id", "x.*")
    best = per_entry.groupBy("field_name", "value").agg(F.max(F.struct("rank", "score", "start", -F.col("ref_id"))).alias("t"), F.slice(F.sort_array(F.collect_list(F.when(F.col("rank") == 1, top)), asc=False), 1, 2).alias("near"))
    close = F.coalesce((F.col("t.rank") == 1) & (F.col("t.score") - F.get("near", F.lit(1))["score"] < LEAD), F.lit(False))
    score = F.when(F.col("t.rank") > 1, F.col("t.rank") + F.col("t.score") / 1e6).otherwise(F.col("t.score"))
    best = best.select("field_name", "value", F.when(close, -1).otherwise(-F.col("t.col4")).alias("ref_id"), F.when(close, 0.0).otherwise(score).alias("score"))
    out = values.select("id", "field_name", "value").join(best, ["field_name", "value"], "left")
    return out.select("id", "field_name", "value", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def typed_values(tables: list[tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(id, field_name, value) of the given (table, key, columns)."""
    out = None
    for df, key, columns in tables:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in columns]))
        part = df.select(F.col(key).cast("string").alias("id"), pairs.alias("x")).select("id", "x.field_name", "x.value")
        out = part if out is None else out.unionByName(part)
    return out
