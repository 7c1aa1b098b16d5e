"""Variant spellings of organisation names: weighted character n-grams, similarity join, average linkage.

Names and tokens are taken apart into founder, family, trade and legal form. The family spellings are
vectors of character n-grams weighted by inverse document frequency; all pairs with both a cosine of at least
``COSINE`` and an edit similarity of at least ``EDITS`` are found: those close by edits first, by a distributed join on
what is left of a piece of a spelling when letters are taken out, then of these the ones with the cosine. The keys are
exact and no list or number of partners is cut. Pairs are grouped by average linkage. Spellings that stand in one row are one node beforehand. Within a family,
trade and founder tell employers apart, and where a name leaves them open its token decides.

Defined results: rows whose name is null or initials only are placed by their token; rows without any spelling long
enough for a vector are placed by their token alone, then by their whole name unless that is initials; rows that name and
token leave open between several employers stand alone; equal rows with different ids are linked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.graphs import average_linkage, components
from lodestar.llm.names import fold, parse_name, parse_token
from lodestar.session import materialize

#: Gram lengths, least cosine of a pair, least average similarity of two clusters, least edit similarity. Two typos in one
#: spelling leave a cosine down to 0.2, since the grams they make are rare and weigh most; the edit check decides.
SIZES, COSINE, LINKAGE, EDITS = (3, 4), 0.2, 0.2, 0.75
#: Forms of one block of a gram's list: a gram of more forms is joined block by block, so that no task gets it whole.
HOT = 10_000
#: Edit similarity from which pairs are looked for by spelling; below, so many letters may differ that the grams find them.
SPELLED = 0.6

_PARTS = "id bigint, name_form string, token_form string, founder string, initial string, trade string, legal string, token string, whole string"


def name_parts(rows: DataFrame, key: str, name: str, token: str) -> DataFrame:
    """(id, name_form, token_form, founder, initial, trade, legal, token) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n, t in zip(b["id"], b["n"], b["t"]):
                x, y = parse_name(n), parse_token(t)
                family = " ".join(sorted(x.family)) or None
                out.append((i, family if family and len(family) > 3 else None, y.family if y and len(y.family) > 5 else None, x.founder or (y.founder if y else None), x.founder_initial, x.trade or (y.trade if y else None), x.legal, y.squashed if y else None, None if x.initials or not n else re.sub(r"[\W_]+", "", fold(n)) or None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARTS.split(", ")])

    return rows.select(F.col(key).cast("bigint").alias("id"), F.col(name).cast("string").alias("n"), F.col(token).cast("string").alias("t")).where("id is not null").mapInPandas(run, _PARTS)


def gram_vectors(forms: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(form, gram, w, df, n): the distinct n-grams of the words of each form, weighted and normalised to length 1."""
    cut = [f"flatten(transform(split(form, ' '), w -> transform(sequence(1, greatest(length(w) - {n - 1}, 0) + cast(length(w) < {n} as int)), i -> substring(w, i, {n}))))" for n in sizes]
    grams = forms.select("form", F.explode(F.array_distinct(F.expr(f"concat({', '.join(cut)})"))).alias("gram")).where("gram <> ''")
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    total = forms.agg(F.count("*").alias("n"))
    x = grams.join(df, "gram").crossJoin(F.broadcast(total)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 0.1)
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("form")))
    return x.select("form", "gram", (F.col("idf") / norm).alias("w"), "df")


def similar_forms(forms: DataFrame, cosine: float = COSINE, edits: float = EDITS, vectors: DataFrame | None = None) -> DataFrame:
    """(u, v, sim): all pairs of forms, u < v, with at least this cosine and edit similarity; ``vectors`` are theirs if at hand."""
    vectors = materialize(gram_vectors(forms), "grams") if vectors is None else vectors
    pairs = _by_spelling(forms, edits) if edits >= SPELLED else _by_grams(forms, vectors, cosine, edits)
    packed = vectors.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("vec"))
    x = pairs.join(packed.select(F.col("form").alias("u"), F.col("vec").alias("vu")), "u").join(packed.select(F.col("form").alias("v"), F.col("vec").alias("vv")), "v")
    dot = F.aggregate(F.map_entries("vu"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("vv", e["key"]), F.lit(0.0)))
    return x.select("u", "v", dot.alias("sim")).where(F.col("sim") >= cosine)


def _by_grams(forms: DataFrame, vectors: DataFrame, cosine: float, edits: float) -> DataFrame:
    """(u, v): pairs of forms that may have this cosine and have this edit similarity, by the rarest grams of each vector; lists of frequent grams in blocks."""
    order = Window.partitionBy("form").orderBy("df", "gram")
    used = F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spelled = forms.select("form", F.replace("form", F.lit(" "), F.lit("")).alias("flat"), F.array_join(F.reverse(F.split("form", " ")), "").alias("turned"))
    spelled = spelled.withColumn("bits", bigram_bits("flat"))
    prefix = vectors.withColumn("left", F.sqrt(F.greatest(1 - used, F.lit(0.0)))).where(F.col("left") >= cosine - 1e-9).select("form", "gram", "left", F.ceil(F.col("df") / HOT).cast("int").alias("blocks")).join(spelled, "form")
    prefix = materialize(prefix, "prefixes")

    def ends(p: DataFrame, block_u: Column, block_v: Column) -> tuple[DataFrame, DataFrame]:
        a = p.select(F.col("form").alias("u"), "gram", block_u.alias("block"), F.col("left").alias("lu"), F.col("flat").alias("fu"), F.col("turned").alias("tu"), F.col("bits").alias("mu"))
        b = p.select(F.col("form").alias("v"), "gram", block_v.alias("block"), F.col("left").alias("lv"), F.col("flat").alias("fv"), F.col("turned").alias("tv"), F.col("bits").alias("mv"))
        return a, b

    # the first gram two vectors share bounds their cosine by what is left of each from there on
    close = (F.col("lu") * F.col("lv") >= cosine - 1e-9) & (F.col("u") < F.col("v")) & close_spelling(edits)
    rare = prefix.where("blocks = 1")
    a, b = ends(rare, F.lit(0), F.lit(0))
    pairs = a.drop("block").join(b.drop("block"), "gram").where(close).select("u", "v")
    frequent = prefix.where("blocks > 1")
    if frequent.limit(1).count():
        a, b = ends(frequent, F.pmod(F.xxhash64("form"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.unionByName(a.join(b, ["gram", "block"]).where(close).select("u", "v"))
    return pairs.distinct()


def _by_spelling(forms: DataFrame, edits: float) -> DataFrame:
    """(u, v): all pairs of forms with at least this edit similarity, their words in either order."""
    flat, turned = F.replace("form", F.lit(" "), F.lit("")), F.array_join(F.reverse(F.split("form", " ")), "")
    spelled = forms.select("form", F.explode(F.array_distinct(F.array(F.struct(flat.alias("s"), F.lit(True).alias("flat")), F.struct(turned.alias("s"), (turned == flat).alias("flat"))))).alias("x"))
    spelled = materialize(spelled.select("form", "x.s", "x.flat"), "spelled")
    near = close_spellings(spelled.groupBy("s").agg(F.max("flat").alias("flat")), edits)
    # of two turned spellings neither is compared: that is the same as comparing the forms' own
    u, v = spelled.select(F.col("form").alias("a"), "s", F.col("flat").alias("fa")), spelled.select(F.col("form").alias("b"), F.col("s").alias("t"), F.col("flat").alias("fb"))
    pairs = near.join(u, "s").join(v, "t").where("a <> b and (fa or fb)")
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _pieces(length: int, edits: int) -> list[tuple[int, int, int, str]]:
    """(start, end, edits, place) of the pieces of a spelling: in any ``edits`` edits of it some piece has no more than its own."""
    n = edits // 3 + 1
    cuts = [i * length // n for i in range(n + 1)]
    each = [(edits - n + 1) // n + (i < (edits - n + 1) % n) for i in range(n)]
    return [(cuts[i], cuts[i + 1], each[i], "w" if n == 1 else "p" if i == 0 else "s" if i == n - 1 else "m") for i in range(n)]


def _less(text: str, letters: int) -> set[str]:
    """What is left of ``text`` without so many of its letters."""
    return {"".join(x) for x in combinations(text, len(text) - letters)}


def spelling_keys(s: str, least: float) -> tuple[list[str], list[str]]:
    """Keys of a spelling as the longer and as the shorter one of a pair: close ones share one of the longer's and the shorter's keys.

    A piece of the longer spelling and its counterpart have all but ``b`` letters of the longer of both in common, in order.
    Counterparts of the first and last piece stand at the shorter one's ends, others up to as many places off as there are edits.
    """
    size, most = len(s), lambda n: math.floor((1 - least) * n)
    own = {place + x for start, end, b, place in _pieces(size, most(size)) for d in range(b + 1) for x in _less(s[start:end], d)}
    cut = set()
    length = size
    while length - size <= most(length):
        k, d = most(length), length - size
        more = (k - d) // 2  # letters that the shorter one can have and the longer one not
        for start, end, b, place in _pieces(length, k):
            m = end - start
            for n in range(max(m - min(b, d + more), 0), min(m + min(b, more), size) + 1):
                starts = {0} if place == "p" else {size - n} if place == "s" else {0} if place == "w" and n == size else set() if place == "w" else range(max(start - k, 0), min(start + k, size - n) + 1)
                cut |= {(place, s[i : i + n], n - max(m, n) + b) for i in starts}
        length += 1
    return sorted(own), sorted({place + x for place, text, letters in cut for x in _less(text, letters)})


def close_spellings(spellings: DataFrame, least: float) -> DataFrame:
    """(s, t): all pairs of spellings (s, flat) with at least this edit similarity, in one order, and each with itself; not those of which neither is flat.

    Candidates share a key of ``spelling_keys``, which leaves eight letters and more to agree in nearly all; a join on single
    grams compares nearly all pairs where names are made of few syllables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b[i : i + 500]
                keys = [spelling_keys(s, least) for s in part["s"]]
                yield pd.DataFrame({"s": part["s"], "flat": part["flat"], "own": [x[0] for x in keys], "cut": [x[1] for x in keys]})

    tasks = int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = spellings.repartition(tasks, "s").mapInPandas(run, "s string, flat boolean, own array<string>, cut array<string>")
    keyed = materialize(keyed.withColumn("bits", bigram_bits("s")), "keyed")
    a = keyed.select(F.col("s"), F.col("flat").alias("fs"), F.col("bits").alias("ms"), F.explode("own").alias("key")).withColumn("key", F.xxhash64("key"))
    b = keyed.select(F.col("s").alias("t"), F.col("flat").alias("ft"), F.col("bits").alias("mt"), F.explode("cut").alias("key")).withColumn("key", F.xxhash64("key"))
    longer = (F.length("s") > F.length("t")) | (F.length("s") == F.length("t")) & (F.col("s") < F.col("t"))
    most = F.floor((1 - least) * F.length("s"))
    possible = (F.col("fs") | F.col("ft")) & longer & (F.length("s") - F.length("t") <= most) & (F.bit_count(F.col("ms").bitwiseXOR(F.col("mt"))) <= 4 * most)
    near = a.join(b, "key").where(possible & (F.levenshtein("s", "t") <= most)).select("s", "t").distinct()
    return near.unionByName(spellings.where("flat").select("s", F.col("s").alias("t")))


def bigram_bits(column: str) -> Column:
    """64 bits, one set for the hash of each pair of neighbouring letters: one edit flips at most four of them."""
    return F.expr(f"aggregate(transform(sequence(1, greatest(length({column}) - 1, 1)), i -> shiftleft(1L, cast(pmod(hash(substring({column}, i, 2)), 64) as int))), 0L, (a, x) -> a | x)")


def close_spelling(least: float) -> Column:
    """Whether forms spelled fu and fv (turned: tu, tv; bigrams mu, mv) are close by edit distance, their words in either order.

    Lengths and bigram bits, which no close pair fails, are compared first; turned spellings only where they
    differ, and turning changes at most two bigrams.
    """
    fu, fv, tu, tv = (F.col(c) for c in ("fu", "fv", "tu", "tv"))
    most = F.floor((1 - least) * F.greatest(F.length(fu), F.length(fv)))
    possible = (F.abs(F.length(fu) - F.length(fv)) <= most) & (F.bit_count(F.col("mu").bitwiseXOR(F.col("mv"))) <= 4 * most + 2)
    near = (F.levenshtein(fu, fv) <= most) | ((tu != fu) & (F.levenshtein(tu, fv) <= most)) | ((tv != fv) & (F.levenshtein(fu, tv) <= most))
    return possible & near


def families(parts: DataFrame) -> DataFrame:
    """(form, family): spellings of one family name."""
    forms = parts.select(F.explode(F.array_compact(F.array("name_form", "token_form"))).alias("form")).distinct()
    forms = materialize(forms, "forms")
    together = components(parts.where("name_form is not null and token_form is not null"), "name_form", "token_form")
    node = materialize(forms.join(together, forms["form"] == together["node"], "left").select("form", F.coalesce("component", "form").alias("node")), "nodes")
    vectors = materialize(gram_vectors(forms), "grams")
    pairs = similar_forms(forms, vectors=vectors)
    x = pairs.join(node.select(F.col("form").alias("u"), F.col("node").alias("nu")), "u").join(node.select(F.col("form").alias("v"), F.col("node").alias("nv")), "v").where("nu <> nv")
    edges = materialize(x.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "sim").groupBy("u", "v").agg(F.max("sim").alias("sim")), "edges")
    size = node.groupBy("node").agg(F.count("*").alias("n"))
    linked = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(size, "node")
    sums = vectors.join(node, "form").groupBy("node", "gram").agg(F.sum("w").alias("w")).join(linked, "node")
    grouped = average_linkage(edges, LINKAGE, sums)
    return node.join(grouped, node["node"] == grouped["node"], "left").select("form", F.coalesce("cluster", node["node"]).alias("family"))


def _only(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the value that all rows of a key which have one agree on."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.where("lo = hi").select(*keys, F.col("lo").alias(name))


def _most(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the most frequent value of a key, the alphabetically first of equally frequent ones."""
    g = rows.where(" and ".join(f"{k} is not null" for k in [*keys, value])).groupBy(*keys, value).agg(F.count("*").alias("c"))
    return g.groupBy(*keys).agg(F.min(F.struct(-F.col("c"), F.col(value))).alias("x")).select(*keys, F.col(f"x.{value}").alias(name))


def link_names(rows: DataFrame, key: str = "company_id", name: str = "company_name", token: str = "company_token") -> DataFrame:
    """(id, entity): the employer of each row; rows left open have an entity of their own."""
    parts = materialize(name_parts(rows, key, name, token), "parts")
    fam = materialize(families(parts), "families")
    x = parts.withColumn("form", F.coalesce("name_form", "token_form")).join(fam, "form", "left").drop("form")
    x = materialize(x, "placed")
    known = x.where("family is not null")
    x = x.join(_most(known, ["family", "token"], "trade", "by_token"), ["family", "token"], "left")
    x = x.join(_only(known, ["family"], "trade", "by_family"), ["family"], "left").join(_only(known.where("legal is not null"), ["family", "legal"], "trade", "by_legal"), ["family", "legal"], "left")
    some = known.groupBy("family").agg(F.count("trade").alias("trades"))
    x = x.join(some, "family", "left").withColumn("trade", F.coalesce("trade", "by_token", "by_family", "by_legal", F.when(F.col("trades") == 0, F.lit("-"))))
    x = materialize(x.drop("by_token", "by_family", "by_legal", "trades"), "traded")
    known = x.where("family is not null and trade is not null")
    one = _only(known, ["family", "trade"], "founder", "only_founder")
    any_ = known.groupBy("family", "trade").agg(F.count("founder").alias("founders"))
    initials = known.where("founder is not null").select("family", "trade", F.substring("founder", 1, 1).alias("initial"), "founder").distinct()
    x = x.join(one, ["family", "trade"], "left").join(any_, ["family", "trade"], "left")
    x = x.join(_only(initials, ["family", "trade", "initial"], "founder", "by_initial"), ["family", "trade", "initial"], "left")
    x = x.join(_most(known, ["family", "trade", "token"], "founder", "by_token"), ["family", "trade", "token"], "left")
    founder = F.when(F.col("founders") == 0, F.lit("-")).otherwise(F.coalesce("only_founder", "founder", "by_initial", "by_token"))
    known_entity = F.concat_ws("|", "family", "trade", founder)
    open_ = F.col("family").isNull() | F.col("trade").isNull() | founder.isNull()
    x = materialize(x.select("id", "family", "token", "whole", F.when(~open_, known_entity).alias("known")), "known")
    # rows too short for a vector go with the rows of their token, if these are one employer, else together by token or name
    bare = x.where("family is null").join(_only(x, ["token"], "known", "by_token"), "token", "left")
    entity = F.coalesce("by_token", F.concat(F.lit("token|"), "token"), F.concat(F.lit("name|"), "whole"), F.concat(F.lit("row|"), "id"))
    placed = x.where("family is not null").select("id", F.coalesce("known", F.concat(F.lit("row|"), "id")).alias("entity"))
    return placed.unionByName(bare.select("id", entity.alias("entity")))


def members(links: DataFrame) -> DataFrame:
    """(company_id, first_id, rows): every row with the least id of its employer's rows and their number; nothing is expanded into pairs."""
    links = materialize(links.distinct(), "links")
    size = links.groupBy("entity").agg(F.min("id").alias("first_id"), F.count("*").alias("rows"))
    return links.join(size, "entity").select(F.col("id").alias("company_id"), "first_id", "rows")


def linked_pairs(links: DataFrame) -> DataFrame:
    """(company_id_a, company_id_b): every two rows of one entity, smaller id first."""
    links = materialize(links.distinct(), "links")
    several = links.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    x = links.join(several, "entity")
    a, b = x.select("entity", F.col("id").alias("company_id_a")), x.select("entity", F.col("id").alias("company_id_b"))
    return a.join(b, "entity").where("company_id_a < company_id_b").select("company_id_a", "company_id_b").distinct()
