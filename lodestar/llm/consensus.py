"""Consensus from several annotators' labels: confusion matrices by expectation-maximisation.

Each person's confusion matrix per field and each item's label posterior are estimated in turn. A matrix
is smoothed towards the person's own overall accuracy (right with that probability, else any other
label), so people with few answers are not trusted or damned on a handful of items. An item's posterior
ranges over the labels somebody gave it.

The votes are shuffled once, into a table bucketed by item. A round reads it, joins the current counts (broadcast when
their checked size allows, which keeps the partitioning) and works out an item's posteriors where its votes lie, so that
only expected counts, summed map-side, are shuffled. The counts of a round are written to the shared folder, so lineage
stays one round long. Rounds end when the expected counts no longer change, by ``TOLERANCE`` of all answers; more than
``MOST_ROUNDS`` raise. Vote rows are never gathered per person or per label, so a person with a third of all answers
is one key of a partial sum; the votes of one item are read in order and may spill.

Defined results: of one person's rows for an item the highest round counts, even if blank; equal rounds
count once (the later, then the larger id); blank answers are no answers; labels compare in lower case,
trimmed; items answered by fewer than ``min_people`` people get no consensus; equal posteriors go to the
alphabetically first label; rows without item, field or person are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import drop_path, is_small, materialize, scratch

#: Share of all expected counts whose change ends the rounds; rounds that never end raise after this many.
TOLERANCE, MOST_ROUNDS = 1e-4, 1_000
#: Weight of the prior in answers per row of a matrix; prior answers and accuracy of a person.
SMOOTHING, PRIOR_N, PRIOR_ACCURACY = 4.0, 4.0, 0.7
MIN_PEOPLE = 3


def final_answers(labels: DataFrame) -> DataFrame:
    """(job_id, field, labeller_id, value): one row per person and item that gave an answer."""
    value = F.nullif(F.lower(F.trim("value")), F.lit(""))
    src = labels.where("job_id is not null and field is not null and labeller_id is not null").select("job_id", "field", "labeller_id", value.alias("value"), "round_no", "labelled_at", "id")
    last = src.groupBy("job_id", "field", "labeller_id").agg(F.max(F.struct("round_no", "labelled_at", "id", "value")).alias("x"))
    return last.select("job_id", "field", "labeller_id", F.col("x.value").alias("value")).where("value is not null")


def vote_pairs(answers: DataFrame) -> DataFrame:
    """(job_id, field, labeller_id, value, label): each answer against each label given to its item."""
    w = Window.partitionBy("job_id", "field")
    return answers.withColumn("labels", F.collect_set("value").over(w)).select("job_id", "field", "labeller_id", "value", F.explode("labels").alias("label"))


KEYS, ITEM = ["field", "labeller_id", "label", "value"], ["job_id", "field"]


def _bucketed(pairs: DataFrame) -> tuple[DataFrame, str]:
    """The vote pairs as a table bucketed and sorted by item, which later rounds need not shuffle; and its name."""
    spark = pairs.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lodestar_votes_{uuid.uuid4().hex[:12]}"
    pairs.repartition(n, *ITEM).write.bucketBy(n, *ITEM).sortBy(*ITEM, "label").option("path", scratch(spark, "votes")).saveAsTable(name)
    return spark.table(name), name


def _posteriors(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``p``, the posterior of its label for its item, from the log likelihoods ``ll`` of its rows."""
    by_label, by_item = Window.partitionBy(*ITEM, "label"), Window.partitionBy(*ITEM)
    x = pairs.withColumn("__s", F.sum("ll").over(by_label) + F.max("__prior").over(by_label)).withColumn("__m", F.count("*").over(by_label))
    x = x.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(by_item)))
    return x.withColumn("p", F.col("__e") / F.sum(F.col("__e") / F.col("__m")).over(by_item)).drop("ll", "__s", "__m", "__e", "__prior")


def _log_likelihoods(expected: DataFrame) -> DataFrame:
    """(field, labeller_id, label, value, n, moved, ll, __prior) of expected counts (field, labeller_id, label, value, n, old).

    Every combination that the vote pairs hold is among the counts, so one inner join applies the table.
    """
    counts = expected.repartition("labeller_id")
    right = F.when(F.col("label") == F.col("value"), F.col("n")).otherwise(0.0)
    person, row = Window.partitionBy("labeller_id"), Window.partitionBy("labeller_id", "field", "label")
    x = counts.withColumn("acc", (F.sum(right).over(person) + PRIOR_N * PRIOR_ACCURACY) / (F.sum("n").over(person) + PRIOR_N)).withColumn("row_n", F.sum("n").over(row))
    by_label = counts.groupBy("field", "label").agg(F.sum("n").alias("label_n"))
    in_field = Window.partitionBy("field")
    k = F.count("*").over(in_field).cast("double")
    prior = by_label.select("field", "label", k.alias("k"), F.log((F.col("label_n") + 1) / (F.sum("label_n").over(in_field) + k)).alias("__prior"))
    x = x.join(prior, ["field", "label"])
    base = F.when(F.col("label") == F.col("value"), F.col("acc")).otherwise((1 - F.col("acc")) / F.greatest(F.col("k") - 1, F.lit(1.0)))
    return x.select(*KEYS, "n", F.abs(F.col("n") - F.col("old")).alias("moved"), F.log((F.col("n") + SMOOTHING * base) / (F.col("row_n") + SMOOTHING)).alias("ll"), "__prior")


def _expected(posteriors: DataFrame) -> DataFrame:
    return posteriors.groupBy(*KEYS).agg(F.sum("p").alias("n"), F.max("old").alias("old"))


def estimate(labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """(job_id, field, labeller_id, value, label, p): every answer against every label of its item, with the label's posterior.

    Rounds go on until the counts settle, or are ``rounds`` in number. Written once: both reports below can use it.
    """
    spark = labels.sparkSession
    pairs, name = _bucketed(vote_pairs(final_answers(labels)))
    w = Window.partitionBy(*ITEM, "label")
    share = F.sum(F.when(F.col("label") == F.col("value"), 1.0).otherwise(0.0)).over(w) / F.count("*").over(w)
    posteriors, old = pairs.withColumn("p", share).withColumn("old", F.lit(0.0)), None
    for i in range(MOST_ROUNDS):
        if i == rounds:
            break
        at = scratch(spark, f"matrices{i}")
        _log_likelihoods(_expected(posteriors)).write.parquet(at)
        if old:
            drop_path(spark, old)
        old = at
        table = spark.read.parquet(at)
        kept = F.broadcast(table) if is_small(table) else table
        moved, total = table.agg(F.sum("moved"), F.sum("n")).first()
        posteriors = _posteriors(pairs.join(kept.select(*KEYS, "ll", "__prior", F.col("n").alias("old")), KEYS))
        if rounds is None and (total is None or moved <= TOLERANCE * total):
            break
    else:
        raise RuntimeError(f"consensus: counts not settled after {MOST_ROUNDS} rounds")
    out = materialize(posteriors.drop("old"), "posteriors")
    for path in filter(None, (old,)):
        drop_path(spark, path)
    spark.sql(f"DROP TABLE {name}")
    return out


def consensus(labels: DataFrame, min_people: int = MIN_PEOPLE, rounds: int | None = None) -> DataFrame:
    """(job_id, field, value, posterior, people) for items answered by at least ``min_people`` people."""
    return consensus_of(estimate(labels, rounds), min_people)


def consensus_of(posteriors: DataFrame, min_people: int = MIN_PEOPLE) -> DataFrame:
    """As :func:`consensus`, of an estimate."""
    p = posteriors.groupBy("job_id", "field", "label").agg(F.max("p").alias("p"), F.count("*").alias("people"))
    best = p.groupBy("job_id", "field").agg(F.min(F.struct(-F.round("p", 9), F.col("label"), F.col("p"), F.col("people"))).alias("x"))
    return best.select("job_id", "field", F.col("x.label").alias("value"), F.col("x.p").alias("posterior"), F.col("x.people").alias("people")).where(F.col("people") >= min_people)


def reliability(labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """(labeller_id, field, answers, accuracy): share of a person's answers expected to be right."""
    return reliability_of(estimate(labels, rounds))


def reliability_of(posteriors: DataFrame) -> DataFrame:
    """As :func:`reliability`, of an estimate."""
    right = F.sum(F.when(F.col("label") == F.col("value"), F.col("p")).otherwise(0.0))
    return posteriors.groupBy("labeller_id", "field").agg(F.round(F.sum("p")).cast("bigint").alias("answers"), (right / F.sum("p")).alias("accuracy"))


def agreement(labels: DataFrame) -> DataFrame:
    """(field, items, answers, observed, alpha): Krippendorff's alpha for nominal labels; null where chance leaves no disagreement."""
    a = final_answers(labels).groupBy("job_id", "field", "value").agg(F.count("*").alias("n"))
    item = a.groupBy("job_id", "field").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    per_item = item.groupBy("field").agg(F.count("*").alias("items"), F.sum("m").alias("answers"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("do"))
    tot = a.join(item.select("job_id", "field"), ["job_id", "field"], "left_semi").groupBy("field", "value").agg(F.sum("n").alias("nc"))
    chance = tot.groupBy("field").agg(F.sum(F.col("nc") * F.col("nc")).alias("sq"))
    r = per_item.join(chance, "field")
    n = F.col("answers")
    do, de = F.col("do") / n, F.try_divide((n * n - F.col("sq")).cast("double"), (n * (n - 1)).cast("double"))
    return r.select("field", "items", "answers", F.round(1 - do, 6).alias("observed"), F.round(1 - F.try_divide(do, de), 6).alias("alpha"))
