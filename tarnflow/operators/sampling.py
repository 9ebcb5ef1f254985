"""Samples of a collection: everything, newest and oldest, or random rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.paths import type_at, value_at

#: Fields that tell a document's time, best first.
DATE_FIELDS = ("meta.updatedAt", "meta.createdAt", "updatedAt", "createdAt", "created_at", "updated_at", "timestamp", "date")


@dataclass
class Sample:
    df: DataFrame
    strategy: str
    total: int
    date_field: str | None = None


def date_field(df: DataFrame, candidates: tuple[str, ...] = DATE_FIELDS) -> str | None:
    """The first candidate of a date type that has a value."""
    typed = [p for p in candidates if isinstance(type_at(df.schema, p), (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if not typed:
        return None
    have = df.agg(*(F.count(value_at(df.schema, p)).alias(f"n{i}") for i, p in enumerate(typed))).first()
    return next((p for i, p in enumerate(typed) if have[i]), None)


def newest_and_oldest(df: DataFrame, path: str, size: int) -> DataFrame:
    """Half of ``size`` rows from either end; ties fall as the other columns do."""
    c, half = value_at(df.schema, path), size // 2
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    newest = df.orderBy(c.desc_nulls_last(), *rest).limit(half)
    oldest = df.orderBy(c.asc_nulls_first(), *rest).limit(half)
    return newest.unionByName(oldest)


def random_rows(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows (or all)."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(size).drop("__r")


def sample(df: DataFrame, size: int = 1000, strategy: str = "stratified", candidates: tuple[str, ...] = DATE_FIELDS, seed: int = 0) -> Sample:
    """At most ``size`` rows. Without a date field, stratified falls back to random."""
    if size < 1 or strategy not in ("stratified", "random"):
        raise ValueError("size must be positive, strategy stratified or random")
    total = df.count()
    if total == 0:
        return Sample(df.limit(0), "empty", 0)
    if total <= size:
        return Sample(df, "all", total)
    field = date_field(df, candidates) if strategy == "stratified" else None
    if field:
        return Sample(newest_and_oldest(df, field, size), "stratified", total, field)
    return Sample(random_rows(df, size, seed), "random", total)
