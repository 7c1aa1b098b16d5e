"""Mixing sources to target weights: balanced sampling by the cube method.

Every distinct text is one unit and belongs to one source (that of its first document). The mix size is
the largest for which each source can meet its share within its repeat cap, or a given number of tokens.
A source's rate (its tokens wanted over its tokens there) gives every text whole copies and a fractional inclusion
probability. The flight phase moves these probabilities through the null space of the balancing
constraints (number of texts, tokens) until they are 0 or 1: blocks of bounded size first, the few undecided
units of all blocks again, until at most two per source remain. The landing phase settles these and a
fixed few units held back for it by the choice closest to the token target.

Only a digest, an id and a size per text are shuffled. Defined results: null and empty texts are not used;
sources without a target are not used, sources without text get an actual share of 0; a share of 0 or null uses
nothing; max_repeats below 1 or null counts as 0 uses.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialize, small_side

#: Units of one flight (bounds a task's memory), seed of its random moves, and most sources with a target.
BLOCK, SEED, MAX_SOURCES = 20_000, 20_240_101, 100_000
#: Units of the landing problem, besides the at most two left by the flight.
LARGEST, MIDDLE = 8, 6
#: Probabilities closer than this to 0 or 1 are decided.
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight: sums of p and of p*x are kept, at most two are undecided."""
    p = p.astype(float).copy()
    undecided = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    u = rng.random(2 * len(undecided) + 2)
    window, nxt, step = undecided[:3], 3, 0
    while len(window) == 3:
        i, j, k = window
        v = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if v[0] == v[1] == v[2] == 0:
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[n]) / d if d > 0 else -p[n] / d for n, d in zip(window, v) if d)
        down = min(p[n] / d if d > 0 else (p[n] - 1) / d for n, d in zip(window, v) if d)
        move = up if u[step % len(u)] * (up + down) < down else -down
        step += 1
        keep = []
        for n, d in zip(window, v):
            p[n] += move * d
            if p[n] < EPS:
                p[n] = 0.0
            elif p[n] > 1 - EPS:
                p[n] = 1.0
            else:
                keep.append(n)
        while len(keep) < 3 and nxt < len(undecided):
            keep.append(undecided[nxt])
            nxt += 1
        window = keep
    return p


def held_for_landing(x: np.ndarray) -> np.ndarray:
    """Units kept out of the last flight: the largest, which otherwise stay undecided longest, and some of middle size to even out."""
    order = np.argsort(-x, kind="stable")
    middle = order[LARGEST:][len(order[LARGEST:]) // 2 :][:MIDDLE]
    return np.concatenate([order[:LARGEST], middle])


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the last undecided units: the choice whose size, then whose number, is closest to the expected one."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(bits @ x[open_] - float((p[open_] * x[open_]).sum()))
    number = np.abs(bits.sum(axis=1) - float(p[open_].sum()))
    out = p.copy()
    out[open_] = bits[np.lexsort((number, np.round(off, 6)))[0]]
    return out


_SCHEMA = "source string, doc_id bigint, n_tokens bigint, p double, block bigint"


def _fly(final: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        rng = np.random.default_rng([SEED, int(pdf["block"].iloc[0]) & 0xFFFFFFFF, len(pdf)])
        order = rng.permutation(len(pdf))
        x = pdf["n_tokens"].to_numpy(dtype=float)[order]
        p = pdf["p"].to_numpy()[order].astype(float)
        if final:
            flying = np.ones(len(p), dtype=bool)
            flying[held_for_landing(x)] = False
            p[flying] = flight(p[flying], x[flying], rng)
            p = land(p, x)
        else:
            p = flight(p, x, rng)
        out = np.empty(len(p))
        out[order] = p
        return pdf.assign(p=out)[["source", "doc_id", "n_tokens", "p", "block"]]

    return run


def mix_units(sized: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens): one row per distinct text, of its first document; ``sized`` is (doc_id, source, digest, n_tokens)."""
    one = sized.where("doc_id is not null and source is not null and digest is not null and n_tokens > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x"))
    return one.select("x.doc_id", "x.source", "x.n_tokens")


def rates(units: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, texts, rate): uses per text that meet the shares."""
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = units.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("texts"))
    r = t.join(have, "source", "left").na.fill(0, ["available_tokens", "texts", "max_repeats"]).na.fill(0.0, ["target_share"])
    room = F.when((F.col("target_share") > 0) & (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0), F.col("max_repeats") * F.col("available_tokens") / F.col("target_share"))
    r = r.crossJoin(F.broadcast(r.agg(F.min(room).alias("largest"))))
    total = F.col("largest") if total_tokens is None else F.lit(float(total_tokens))
    rate = F.when(F.col("available_tokens") > 0, F.least(total * F.col("target_share") / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return r.withColumn("rate", F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0))).drop("largest")


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, rates): selection is (doc_id, source, n_tokens, repeats) with at least one use each.

    ``sized`` is (doc_id, source, digest, n_tokens), ``digest`` telling equal texts; it is read once, and joined to nothing.
    """
    units = materialize(mix_units(sized), "units")
    r = materialize(rates(units, targets, total_tokens), "rates")
    x = units.join(small_side(r.select("source", "rate", "texts")), "source")
    whole = F.floor(F.col("rate") + EPS)
    x = x.select("source", "doc_id", "n_tokens", whole.cast("int").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), F.ceil(F.col("texts") / BLOCK).cast("bigint").alias("blocks"))
    base = x.select("source", "doc_id", "n_tokens", "whole")
    open_ = x.where(F.col("p") > EPS).select("source", "doc_id", "n_tokens", "p", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"))
    decided, level = None, 0
    while True:
        counts = open_.groupBy("source").agg(F.countDistinct("block").alias("b"), F.count("*").alias("n"))
        final = counts.where("b > 1").limit(1).count() == 0
        flown = materialize(open_.groupBy("source", "block").applyInPandas(_fly(final), _SCHEMA), "flown")
        sure = flown.where(f"p < {EPS} or p > 1 - {EPS}")
        decided = sure if decided is None else decided.unionByName(sure)
        if final:
            break
        level += 1
        rest = flown.where(f"p >= {EPS} and p <= 1 - {EPS}")
        n = rest.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("blocks"))
        open_ = rest.drop("block").join(small_side(n), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), "blocks")).drop("blocks")
    chosen = decided.where("p > 0.5").select("source", "doc_id", F.lit(1).alias("extra"))
    out = base.join(chosen, ["source", "doc_id"], "left").withColumn("repeats", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"), r


def shares(selection: DataFrame, r: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, used_tokens, available_tokens, texts_used, most_repeats, max_repeats)."""
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("texts_used"), F.max("repeats").alias("most_repeats"))
    x = r.join(used, "source", "left").na.fill(0, ["used_tokens", "texts_used", "most_repeats"])
    x = x.crossJoin(F.broadcast(x.agg(F.sum("used_tokens").alias("all_tokens"))))
    return x.select("source", "target_share", F.try_divide("used_tokens", "all_tokens").alias("actual_share"), "used_tokens", "available_tokens", "texts_used", "most_repeats", "max_repeats")


