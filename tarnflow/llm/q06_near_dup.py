"""Registered query of near-duplicate detection, on two-word shingles as its contract asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm._scratch import load
from tarnflow.llm.near_dup import near_duplicates


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op6_near_dup": op6_near_dup}
ORACLES: dict[str, str] = {}
