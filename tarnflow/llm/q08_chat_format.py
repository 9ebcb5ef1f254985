"""Registered query of chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm._scratch import load, materialize
from tarnflow.llm.chat_format import canonical_turns, format_turns, read_conversations

#: The conversation that every run adds: texts made of control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    probe = spark.createDataFrame(PROBE, table.schema)
    record = F.to_json(F.struct("role", "text"))
    turns = canonical_turns(table.unionByName(probe), F.struct("conv_id", "turn"), record)
    turns = turns.select("key.conv_id", "key.turn", "role", "text")
    formatted, _ = materialize(spark, format_turns(turns), "chat")
    return read_conversations(formatted)


QUERIES = {"op8_chat_format": op8_chat_format}
ORACLES: dict[str, str] = {}
