"""Shared-folder intermediates and session settings used by the operators here.

Intermediates go to the folder named by ``spark.checkpoint.dir`` so that any
executor (or a replacement for a lost one) can read them again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python stay under this many bytes, whatever the length of single texts.
ARROW_BATCH_BYTES = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder; returns the table read back and its path."""
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The intermediates of one run: written once, and deleted together when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        out, path = materialize(self.spark, df, label)
        self.kept.append((out, path))
        return out

    def release(self, *tables: DataFrame) -> None:
        """Delete the given tables, or all."""
        gone = [(df, path) for df, path in self.kept if not tables or any(df is t for t in tables)]
        release(self.spark, *(path for _, path in gone))
        self.kept = [x for x in self.kept if not any(x is g for g in gone)]


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that very long texts do not meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
