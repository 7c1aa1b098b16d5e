"""Readers for the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with the job number of ``props`` as ``job_id`` (bigint)."""
    return table(spark, folder, "events").withColumn("job_id", F.get_json_object("props", "$.k").cast("bigint"))
