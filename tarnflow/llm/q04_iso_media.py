"""Registered query of the media containers: every text stored as a track and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm._scratch import load, scratch_path
from tarnflow.llm.iso_media import payload_digest, store_texts, write_media


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(load(spark, sf_dir, "documents"), F.col("text"))
    return payload_digest(write_media(stored, scratch_path(spark, "media")))


QUERIES = {"op4_iso_media": op4_iso_media}
ORACLES: dict[str, str] = {}
