"""Registered query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm._scratch import load
from tarnflow.llm.secret_scan import scan, span_text


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        F.size("assign").cast("bigint").alias("n_assign"),
        F.size("access").cast("bigint").alias("n_access"),
        F.size("hex").cast("bigint").alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.concat(base, F.col("random"))).alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
