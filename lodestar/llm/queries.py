"""Queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.catalog import table
from lodestar.llm import canonical, consensus, entities, history, mixing, packing, sentences, tokens
from lodestar.llm.oracle import ORACLE  # noqa: F401


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return entities.linked_pairs(entities.link_names(table(spark, folder, "companies")))


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its employer, without pairs."""
    return entities.members(entities.link_names(table(spark, folder, "companies")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.repeated_postings(table(spark, folder, "posting_batches"))


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    values = canonical.typed_values([(table(spark, folder, "jobs"), "id", ["location_raw", "department"]), (table(spark, folder, "jobs_app"), "id", ["seniority_level"])])
    return canonical.map_values(values, table(spark, folder, "canonical_values"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _canonical(spark, folder).select("id", "field_name", "ref_id").distinct()


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values without an entry, and how often each was typed."""
    return _canonical(spark, folder).where("ref_id = -1").groupBy("field_name", "value").count().withColumnRenamed("count", "times")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(table(spark, folder, "eval_labels")).select("job_id", "field", "value")


def p6_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliability(table(spark, folder, "eval_labels"))


def p6_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.agreement(table(spark, folder, "eval_labels"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, folder, "documents")), table(spark, folder, "pack_limits"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, folder), table(spark, folder, "pack_limits"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").withColumn("digest", F.sha2("text", 256))
    return mixing.mix(tokens.count_tokens(docs, keep=("source", "digest")), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_members, p3_found, p3_unmatched, p6_found, p6_reliability, p6_agreement, p7_found, p8_packed, p8_fill, p9_mix, p9_shares, p10_found)}
