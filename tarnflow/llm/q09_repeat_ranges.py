"""Registered query of the removal of repeated byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm._scratch import load
from tarnflow.llm.repeat_ranges import without_repeats


def op9_repeat_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


QUERIES = {"op9_repeat_ranges": op9_repeat_ranges}
ORACLES: dict[str, str] = {}
