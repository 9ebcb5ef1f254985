"""Registered query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm._scratch import load
from tarnflow.llm._training import is_held_out
from tarnflow.llm.toxicity import scores, train

THRESHOLD = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
