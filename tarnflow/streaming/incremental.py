"""Incremental loads as a stream: the checkpoint keeps the position that the state table keeps in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnflow.operators.filters import compile_filter
from tarnflow.operators.transforms import Pipeline
from tarnflow.sources.catalog import exists
from tarnflow.sources.sinks import write


def load_stream(spark: SparkSession, source: str, schema: T.StructType, destination: str, checkpoint: str, *, key: str, match: dict | None = None, transforms: list[dict] | None = None, disposition: str = "merge", error_mode: str = "skip", files_per_batch: int | None = None) -> int:
    """Take every file of ``source`` that the checkpoint has not seen; returns the number of batches.

    Each micro-batch is filtered, transformed and written by the batch sink, so a
    batch that runs again after a failure merges to the same table. Append takes
    the keys that the table lacks, for the same reason; replace would leave the
    last batch only and is refused.
    """
    if disposition not in ("merge", "append"):
        raise ValueError("a stream merges or appends")
    pipeline = Pipeline(transforms or [], error_mode)
    done = 0

    def one(rows: DataFrame, _: int) -> None:
        nonlocal done
        chosen = rows.where(compile_filter(match, rows.schema)) if match else rows
        new = pipeline.apply(chosen).df
        if disposition == "append" and exists(spark, destination):
            new = new.join(spark.read.parquet(destination).select(key), key, "left_anti")
        write(new, destination, disposition, key)
        done += 1

    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    query = reader.load(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done
