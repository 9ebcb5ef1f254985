"""Registered query of the token-shard operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnflow.llm._scratch import load, scratch_path
from tarnflow.llm.token_shards import checksums, read_shards, with_global_start, write_shards

TOKENIZER = "byte_bpe_50k.json"


def shard_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    write_shards(docs, path, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    shards = read_shards(spark, path)
    return with_global_start(checksums(shards), shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(spark, load(spark, sf_dir, "documents"))


QUERIES = {"op2_token_shards": op2_token_shards}
ORACLES: dict[str, str] = {}
