"""Deduplicating new batches against all history: a persisted prefix-tree hash forest.

A text becomes the set of its word shingles, and each of ``TREES`` trees the sequence of two minima of that set
under random orders. A record's place in a tree is one 64-bit key: the hash of its context (employer and role
initials), the tree, and the minima from the first to the last, so that a prefix of the sequence is a range of keys.
Runs of the forest are tables of (key, no) sorted by key, cut into files of about ``FILE_ROWS`` rows whose least and
greatest key stand in the folder's manifest; a forest opened on the same folder again goes on where it was.

A batch looks up the ranges of its keys: only files whose range they touch are opened, the run of the batch itself
among them. Candidates are verified on whole texts from the longest common prefix to the shortest: after each depth
the pairs found so far, each weighted with its chance of sharing so long a prefix at its similarity, give an estimate
of the recall, and the prefix is widened until the estimate meets ``RECALL`` or the prefix is a single minimum.
Runs of about equal size are merged in fours, so a row is rewritten a logarithmic number of times.

Copies (same employer, role and words in order) are found by range search in sorted runs of their own; of each
copy only the first enters the forest, once for each context it brings.

Defined results: records without a text, or with a text of no words, or without token and name, are no cases; the
first record of a posting is the one with the smallest number among all records linked directly or by others; texts
under ``WORDS`` words match only as a whole; markup is no wording; a record delivered again under its own number is no
repeat of itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.canonical import edit_distance
from lodestar.llm.names import parse_name, parse_token
from lodestar.operators.graphs import components
from lodestar.session import BROADCAST_BYTES, BROADCAST_ROWS, bounded_rows, drop_path, list_names, read_text, scratch, write_text

#: Words of a shingle; trees, and bits kept of each minimum of a tree's sequence; recall at which prefixes stop widening.
WORDS, TREES, BITS, RECALL = 4, 16, (16, 16), 0.999
#: Share of the shorter text's words that must recur (in runs of at least WORDS words) in the other.
COVERAGE = 0.7
#: Rows of a file of a run; runs of about equal size that are merged into one; most batches of one call.
FILE_ROWS, MERGE_RUNS, MAX_BATCHES = 1_000_000, 4, 100_000
#: How many rows of a run a text counts as, for the size of its file.
TEXT_WEIGHT = 16
#: Number of files up to which all are opened, since asking which are touched would take longer (same result either way).
PRUNE_ABOVE = 16

DEPTH = len(BITS)
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
SHORT_TITLES = {"sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "eng": "engineer", "engr": "engineer", "mgr": "manager", "dev": "developer", "admin": "administrator", "assoc": "associate", "asst": "assistant", "coord": "coordinator", "spec": "specialist", "tech": "technician", "rep": "representative", "exec": "executive", "dir": "director", "prog": "program", "ml": "machine learning", "sre": "site reliability engineer"}


def met(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that two texts of this similarity share a prefix of ``depth`` minima in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def words_of(text: str) -> list[str]:
    """Lower-case words of a text without markup."""
    return re.findall(r"\w+", re.sub(r"<[^<>]{0,200}>", " ", text).lower())


def role_of(title: str | None) -> list[str]:
    """Canonical words of a job title: notes in brackets and shortenings resolved."""
    t = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", (title or "").lower())
    return [w for x in re.findall(r"[^\W_]+", t) for w in SHORT_TITLES.get(x, x).split()]


class WordCodes(dict):
    """64-bit code of a word, the same on every machine; remembers words."""

    def __missing__(self, w: str) -> int:
        b = w.encode()
        c = self[w] = zlib.crc32(b) | (zlib.adler32(b[::-1]) << 32)
        return c


def shingles(texts: list[list[str]], codes: WordCodes) -> list[np.ndarray]:
    """64-bit hashes of each run of ``WORDS`` words of each text in order; one for all of a shorter text."""
    flat = np.array([c for t in texts for c in map(codes.__getitem__, t)] + [0] * WORDS, dtype=np.uint64)
    runs = len(flat) - WORDS + 1
    out, at, start = np.zeros(runs, dtype=np.uint64), [], 0

    def step(h: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (c * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k))
        return h ^ (h >> np.uint64(29))

    with np.errstate(over="ignore"):
        for k in range(WORDS):
            out = step(out, flat[k : k + runs], k)
        for t in texts:
            if len(t) >= WORDS:
                at.append(out[start : start + len(t) - WORDS + 1])
            else:
                h = np.zeros(1, dtype=np.uint64)
                for k in range(len(t)):
                    h = step(h, flat[start + k : start + k + 1], k)
                at.append(h)
            start += len(t)
    return at


def whole_hash(words: list[str]) -> int:
    """64-bit hash of all words in order."""
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True)


def signatures(grams: list[np.ndarray]) -> np.ndarray:
    """One 32-bit row per tree and text: the bits of its minima, first one in front."""
    flat, starts = np.concatenate(grams), np.cumsum([0] + [len(g) for g in grams[:-1]])
    out = np.zeros((len(grams), TREES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(TREES * DEPTH):
            h = flat * _A[k] + _B[k]
            h ^= h >> np.uint64(32)
            least = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), starts)
            bits = BITS[k % DEPTH]
            kept = ((least ^ (least >> np.uint64(17))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
            out[:, k // DEPTH] = (out[:, k // DEPTH] << np.uint32(bits)) | kept.astype(np.uint32)
    return out.view(np.int32)


_RECORD = "no bigint, batch bigint, sig array<int>, grams array<int>, words int, digest bigint, employer string, family string, role string, initials string"


def records(batch: DataFrame, number: str, batch_no: str, token: str, name: str, title: str, text: str) -> DataFrame:
    """Signature, canonical employer and role, and shingles of each record that has a text.

    ``family`` is the sorted family words of the name, a bar and its trade.
    """
    src = batch.select(F.col(number).cast("bigint").alias("no"), F.col(batch_no).cast("bigint").alias("batch"), F.col(token).cast("string").alias("token"), F.col(name).cast("string").alias("name"), F.col(title).cast("string").alias("title"), F.col(text).cast("string").alias("text")).where("no is not null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()

        @functools.lru_cache(maxsize=20_000)
        def employer(token: str | None, name: str | None) -> tuple[str, str]:
            tok, nam = parse_token(token), parse_name(name)
            return tok.squashed if tok else "", " ".join(sorted(nam.family)) + "|" + (nam.trade or "") if nam.family else ""

        @functools.lru_cache(maxsize=20_000)
        def role(title: str | None) -> tuple[str, str]:
            r = role_of(title)
            return " ".join(r), "".join(sorted(x[0] for x in r))

        for whole in batches:
            for at in range(0, len(whole), 256):
                out, texts = [], []
                if len(codes) > 50_000:
                    codes.clear()
                for r in whole.iloc[at : at + 256].itertuples(index=False):
                    if w := words_of(r.text):
                        texts.append(w)
                        out.append((r.no, r.batch, len(w), whole_hash(w), *employer(r.token, r.name), *role(r.title)))
                if not out:
                    continue
                grams = shingles(texts, codes)
                df = pd.DataFrame(out, columns=["no", "batch", "words", "digest", "employer", "family", "role", "initials"])
                df["grams"], df["sig"] = [g.view(np.int64).astype(np.int32) for g in grams], list(signatures(grams))
                yield df[[c.split()[0] for c in _RECORD.split(", ")]]

    return src.mapInPandas(run, _RECORD)


def _contexts(recs: DataFrame) -> DataFrame:
    """(no, exact, ctx): per record its employer by token and by name; ``exact`` is the key of a copy's run, ``ctx`` 28 bits."""
    who = F.explode(F.array_compact(F.array(F.when(F.col("employer") != "", F.concat(F.lit("t"), "employer")), F.when(F.col("family") != "", F.concat(F.lit("n"), "family")))))
    x = recs.select("no", who.alias("who"), "role", "initials", "digest", "words")
    return x.select("no", F.xxhash64("who", "role", "digest", "words").alias("exact"), F.xxhash64("who", "initials").bitwiseAND(F.lit((1 << 28) - 1)).alias("ctx"))


def _tree_keys(sigs: DataFrame) -> DataFrame:
    """(key, no) of rows (no, ctx, sig): one per tree."""
    x = sigs.select("no", "ctx", F.posexplode("sig").alias("tree", "s"))
    key = F.shiftleft("ctx", 36).bitwiseOR(F.shiftleft(F.col("tree").cast("bigint"), 32)).bitwiseOR(F.col("s").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)))
    return x.select(key.alias("key"), "no")


def _below(depth: int) -> int:
    """Bits of a key below its first ``depth`` minima."""
    return sum(BITS[depth:])


def coverage(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Share of the shorter text's words that lie in a run of words the other text has too."""
    if na > nb:
        a, b, na, nb = b, a, nb, na
    hits = np.flatnonzero(np.isin(a, b))
    covered = np.zeros(max(na, 1), dtype=bool)
    for k in range(min(WORDS, na)):
        covered[np.minimum(hits + k, na - 1)] = True
    return float(covered.mean())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all shingles of two texts."""
    a, b = np.unique(a), np.unique(b)
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / max(1, len(a) + len(b) - same)


def same_role(a: str, b: str) -> bool:
    """Whether two canonical titles are one role, each word typed with at most one error."""
    if a == b:
        return True
    x, y = a.split(), b.split()
    return len(x) == len(y) and all(p == q or min(len(p), len(q)) >= 5 and edit_distance(p, q, 1) <= 1 for p, q in zip(x, y))


def same_employer(ta: str, tb: str, fa: str, fb: str) -> bool:
    """Whether tokens, or else names, state one employer; a name without a trade only where a token is missing."""
    if ta and ta == tb:
        return True
    return bool(fa) and fa == fb and (not fa.endswith("|") or not (ta and tb))


_FOUND = "first bigint, again bigint, similarity double"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose employer, role and wording are the same."""
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        text = {n: col[n].to_pylist() for n in ("employer_a", "employer_b", "family_a", "family_b", "role_a", "role_b", "words_a", "words_b")}
        flat = {s: (np.asarray(col[f"grams_{s}"].flatten()), np.asarray(col[f"grams_{s}"].offsets) - col[f"grams_{s}"].offsets[0].as_py()) for s in "ab"}
        keep, sim = [], []
        for i in range(b.num_rows):
            if not (same_employer(text["employer_a"][i], text["employer_b"][i], text["family_a"][i], text["family_b"][i]) and same_role(text["role_a"][i], text["role_b"][i])):
                continue
            x, y = (flat[s][0][flat[s][1][i] : flat[s][1][i + 1]] for s in "ab")
            if coverage(x, y, text["words_a"][i], text["words_b"][i]) >= COVERAGE:
                keep.append(i)
                sim.append(jaccard(x, y))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([col["first"].take(at), col["again"].take(at), pa.array(sim, pa.float64())], names=["first", "again", "similarity"])


def _hinted(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when its known number of rows and their size keep to the bounds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


class Forest:
    """The persisted forest in one folder all executors reach; opening a folder that holds one continues it.

    The manifest names every table with its kind (``tree``, ``exact``, ``text``, ``link``), rows, and the least and
    greatest key of each file. It is replaced as a whole after a batch, so a batch that fails leaves the forest as it was.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, file_rows: int = FILE_ROWS):
        self.spark, self.folder, self.file_rows = spark, (folder or scratch(spark, "forest")).rstrip("/"), file_rows
        self.tables: list[dict] = []
        self.count = self._written = 0
        #: Files opened and there were, by kind, in the last lookup; prefix depth and recall estimated in the last batch.
        self.opened: dict[str, tuple[int, int]] = {}
        self.depth, self.recall = DEPTH, 0.0
        if "manifest.json" in list_names(spark, self.folder):
            state = json.loads(read_text(spark, f"{self.folder}/manifest.json"))
            self.tables, self.count = state["tables"], state["count"]

    def _fresh(self, kind: str) -> str:
        self._written += 1
        return f"{self.folder}/{kind}-{self.count}-{self._written}"

    def _of(self, kind: str) -> list[dict]:
        return [t for t in self.tables if t["kind"] == kind]

    def _add(self, kind: str, df: DataFrame, key: str, rows: int, replaces: tuple = ()) -> int:
        """Write ``df``, of about ``rows`` rows, as a sorted table in files of about ``file_rows`` rows and note their ranges of ``key``; (rows written)."""
        path, n = self._fresh(kind), max(1, math.ceil(rows / self.file_rows))
        df = df.repartitionByRange(n, key) if n > 1 else df.coalesce(1)
        df.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
        spans = self.spark.read.schema(f"{key} bigint").parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).collect()
        written = sum(r["n"] for r in spans)
        self.tables = [t for t in self.tables if t not in replaces] + [{"kind": kind, "path": path, "rows": written, "files": sorted([r["lo"], r["hi"], r["f"]] for r in spans)}]
        return written

    def _commit(self) -> None:
        """Make the new state the forest's, then remove tables it no longer names."""
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps({"count": self.count, "tables": self.tables}))
        known = {t["path"].rsplit("/", 1)[1] for t in self.tables}
        for name in list_names(self.spark, self.folder):
            if name.split("-")[0] in ("tree", "exact", "text", "link", "work") and name not in known:
                drop_path(self.spark, f"{self.folder}/{name}")

    def _touched(self, kind: str, probes: DataFrame, lo: Column, hi: Column, schema: str) -> DataFrame | None:
        """The files of a kind whose range meets a probe's, as one table; the ranges are compared where the probes are."""
        tables = [t for t in self._of(kind) if t["files"]]
        total = sum(len(t["files"]) for t in tables)
        if 0 < total <= PRUNE_ABOVE:
            self.opened[kind] = (total, total)
            return self.spark.read.schema(schema).parquet(*[t["path"] for t in tables])
        bounds = [(np.array([f[0] for f in t["files"]]), np.array([f[1] for f in t["files"]])) for t in tables]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, q = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for i, (lows, highs) in enumerate(bounds):
                    spans = np.unique(np.stack([np.searchsorted(highs, p, "left"), np.searchsorted(lows, q, "right")]), axis=1)
                    hit = sorted({int(j) for s, e in spans.T for j in range(s, e)})
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(hit), pa.int32()), pa.array(hit, pa.int32())], names=["t", "f"])

        rows = probes.select(lo.alias("lo"), hi.alias("hi")).mapInArrow(run, "t int, f int").distinct().collect() if tables else []
        self.opened[kind] = (len(rows), total)
        paths = sorted(f"{tables[r['t']]['path']}/{tables[r['t']]['files'][r['f']][2]}" for r in rows)
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _merge(self) -> None:
        """Merge runs of one size class once there are ``MERGE_RUNS`` of them."""
        for kind in ("tree", "exact"):
            while True:
                tiers: dict[int, list[dict]] = {}
                for t in self._of(kind):
                    tiers.setdefault(int(math.log(max(t["rows"], 1), MERGE_RUNS)), []).append(t)
                full = next((ts for _, ts in sorted(tiers.items()) if len(ts) >= MERGE_RUNS), None)
                if full is None:
                    break
                rows = self.spark.read.schema("key bigint, no bigint").parquet(*[t["path"] for t in full])
                rows = rows.groupBy("key").agg(F.min("no").alias("no")) if kind == "exact" else rows
                self._add(kind, rows, "key", sum(t["rows"] for t in full), tuple(full))

    def ingest(self, recs: DataFrame, rows: int | None = None) -> DataFrame:
        """Accept a batch of :func:`records`, of ``rows`` rows if that is known; (first, again) links of its records with earlier ones or each other."""
        work, before = f"{self.folder}/work-{self.count}", len(self._of("link"))
        keyed, probe = _contexts(recs), F.col("exact")
        heads = keyed.groupBy("exact", "ctx").agg(F.min("no").alias("head"))
        known = self._touched("exact", keyed, probe, probe, "key bigint, no bigint")
        if known is None:
            heads = heads.withColumn("old", F.lit(None).cast("bigint"))
        else:
            heads = known.groupBy(F.col("key").alias("exact")).agg(F.min("no").alias("old")).join(heads, "exact", "right")
        self._add("exact", heads.select(F.col("exact").alias("key"), "ctx", F.coalesce("old", "head").alias("no"), F.col("old").isNull().alias("fresh")), "key", 2 * (recs.count() if rows is None else rows))
        exact = self._of("exact")[-1]
        fresh, heads = exact["rows"], self.spark.read.schema("key bigint, ctx bigint, no bigint, fresh boolean").parquet(exact["path"])
        entering = _hinted(heads.where("fresh").groupBy("no").agg(F.collect_set("ctx").alias("ctxs")), fresh, 64)
        texts = recs.join(entering, "no")
        copies = keyed.join(_hinted(heads.select(F.col("key").alias("exact"), F.col("no").alias("first")), exact["rows"], 16), "exact").where("no <> first")
        copies = copies.select(F.least("no", "first").alias("first"), F.greatest("no", "first").alias("again")).distinct()
        kept = self._add("text", texts.select("no", "grams", "words", "employer", "family", "role"), "no", fresh * TEXT_WEIGHT)
        if kept:
            self._add("tree", _tree_keys(texts.select("no", F.explode("ctxs").alias("ctx"), "sig")), "key", fresh * TREES)
            copies = self._search(work, copies)
        if copies is not None:
            self.tables.append({"kind": "link", "path": self._fresh("link"), "rows": None, "files": []})
            copies.write.mode("overwrite").parquet(self.tables[-1]["path"])
        mine = [t["path"] for t in self._of("link")[before:]]
        self._merge()
        self.count += 1
        self._commit()
        return self._pairs(mine)

    def _search(self, work: str, copies: DataFrame | None) -> DataFrame | None:
        """Add the verified pairs of the newest run with all runs, the prefix widened from the longest until the recall is met.

        ``copies`` are links to be written along with the first of them; returned if there were none.
        """
        newest = self._of("tree")[-1]
        mine = self.spark.read.schema("key bigint, no bigint").parquet(newest["path"])
        low = _below(1)
        floor = F.shiftleft(F.shiftright("key", low), low)
        index = self._touched("tree", mine, floor, floor.bitwiseOR(F.lit((1 << low) - 1)), "key bigint, no bigint")
        a = index.select(F.shiftright("key", low).alias("prefix"), F.col("key").alias("ka"), F.col("no").alias("a"))
        b = _hinted(mine.select(F.shiftright("key", low).alias("prefix"), F.col("key").alias("kb"), F.col("no").alias("b")), newest["rows"], 24)
        depth = F.lit(1)
        for d in range(2, DEPTH + 1):
            depth = F.when(F.shiftright("ka", _below(d)) == F.shiftright("kb", _below(d)), d).otherwise(depth)
        pairs = a.join(b, "prefix").where("a <> b").groupBy(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("again")).agg(F.max(depth).alias("depth"))
        pairs.write.mode("overwrite").parquet(f"{work}-pairs")
        pairs = self.spark.read.schema("first bigint, again bigint, depth int").parquet(f"{work}-pairs")
        counts = dict.fromkeys(range(1, DEPTH + 1), 0) | {r["depth"]: r["count"] for r in pairs.groupBy("depth").count().collect()}
        self.depth, self.recall = DEPTH, 1.0
        if not sum(counts.values()):
            return copies
        ends = pairs.select(F.explode(F.array("first", "again")).alias("no"))
        texts = self._touched("text", ends, F.col("no"), F.col("no"), "no bigint, grams array<int>, words int, employer string, family string, role string")
        found, weight = 0, dict.fromkeys(counts, 0.0)
        for d in range(DEPTH, 0, -1):
            self.depth = d
            if counts[d]:
                path = self._fresh("link")
                wave = self.verified(pairs.where(F.col("depth") == d), texts, counts[d])
                (wave if copies is None else wave.unionByName(copies, allowMissingColumns=True)).write.mode("overwrite").parquet(path)
                copies = None
                self.tables.append({"kind": "link", "path": path, "rows": None, "files": []})
                chance = [1 - F.pow(1 - F.pow(F.greatest("similarity", F.lit(0.02)), F.lit(float(x))), F.lit(float(TREES))) for x in counts]
                got = self.spark.read.schema(_FOUND).parquet(path).where("similarity is not null").agg(F.count("*"), *[F.coalesce(F.sum(1 / c), F.lit(0.0)) for c in chance]).first()
                found += got[0]
                weight = {x: weight[x] + g for x, g in zip(weight, got[1:])}
            self.recall = found / weight[d] if weight[d] else 0.0
            if self.recall >= RECALL:
                break
        return copies

    def verified(self, pairs: DataFrame, texts: DataFrame, count: int) -> DataFrame:
        """(first, again, similarity) of ``count`` pairs, where employer, role and wording are the same."""
        sides, pairs = [], _hinted(pairs.select("first", "again"), count, 16)
        for end, side in (("first", "a"), ("again", "b")):
            t = texts.select(F.col("no").alias(end), *[F.col(c).alias(f"{c}_{side}") for c in ("grams", "words", "employer", "family", "role")])
            sides.append(t.join(pairs, end))
        return sides[0].join(sides[1], ["first", "again"]).mapInArrow(_check, _FOUND)

    def _pairs(self, paths: list[str]) -> DataFrame:
        links = "first bigint, again bigint"
        return self.spark.read.schema(links).parquet(*paths).distinct() if paths else self.spark.createDataFrame([], links)

    def links(self) -> DataFrame:
        """(first, again) links of all batches so far."""
        return self._pairs([t["path"] for t in self._of("link")])


def repeated_postings(postings: DataFrame, number: str = "posting_no", batch_no: str = "batch_no", token: str = "company_token", name: str = "company_name", title: str = "title", text: str = "description_text", folder: str | None = None) -> DataFrame:
    """(posting_no_first, posting_no_again): every record that delivers a posting again, with that posting's first record.

    Batches are accepted one after the other in order of ``batch_no``, null first; ``folder`` names a forest to continue.
    """
    spark = postings.sparkSession
    path = scratch(spark, "records")
    batch = F.coalesce(F.col(batch_no).cast("bigint"), F.lit(-(1 << 62))).alias("__batch")
    records(postings.select(F.col(number), batch, token, name, title, text), number, "__batch", token, name, title, text).write.partitionBy("batch").parquet(path)
    staged = spark.read.schema(_RECORD).parquet(path)
    sizes = {r["batch"]: r["count"] for r in bounded_rows(staged.groupBy("batch").count(), MAX_BATCHES, "batches")}
    forest = Forest(spark, folder)
    for n in sorted(sizes):
        forest.ingest(staged.where(F.col("batch") == n), sizes[n])
    linked = components(forest.links(), "first", "again")
    drop_path(spark, path)
    return linked.where("node <> component").select(F.col("component").alias("posting_no_first"), F.col("node").alias("posting_no_again"))
