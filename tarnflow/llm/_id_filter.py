"""A Bloom filter of fixed size over row keys, to keep other rows' texts out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter has this many bits (8 MB) whatever the number of keys; when it is
#: full it lets every row through, and the join that follows drops the rest.
FILTER_BITS = 1 << 26


class IdFilter:
    def __init__(self, shared):
        self.shared = shared

    @staticmethod
    def hashes(*keys: str) -> tuple[Column, Column]:
        """The two hashes of a key, as columns for ``has``."""
        return F.xxhash64(*keys).alias("_h1"), F.xxhash64(*keys, F.lit(1)).alias("_h2")

    @classmethod
    def of(cls, df: DataFrame, *keys: str) -> IdFilter:
        spots = df.select(F.explode(F.array(*(F.pmod(h, F.lit(FILTER_BITS)) for h in cls.hashes(*keys)))).alias("spot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("spot"), F.lit(64)).cast("int"))
        rows = spots.groupBy(F.floor(F.col("spot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(FILTER_BITS // 64, np.int64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        return cls(df.sparkSession.sparkContext.broadcast(words))

    def has(self, first: pa.Array, second: pa.Array) -> np.ndarray:
        hit = np.ones(len(first), bool)
        for column in (first, second):
            spot = column.to_numpy() % FILTER_BITS
            hit &= (self.shared.value[spot // 64] >> (spot % 64)) & 1 == 1
        return hit
