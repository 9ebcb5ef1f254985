"""Registered query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm._scratch import load
from tarnflow.llm.decontaminate import leaks


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict[str, str] = {}
