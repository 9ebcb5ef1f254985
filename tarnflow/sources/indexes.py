"""Index definitions: kept as metadata; uniqueness and expiry are what they mean for a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators.filters import compile_filter, resolve


@dataclass(frozen=True)
class Index:
    name: str
    keys: tuple[tuple[str, object], ...]  # (field, 1 | -1 | "text" | "2d" | "2dsphere" | "hashed")
    unique: bool = False
    sparse: bool = False
    expire_after_seconds: int | None = None
    partial_filter: dict | None = field(default=None, hash=False)
    collation: dict | None = field(default=None, hash=False)

    @staticmethod
    def of(spec: dict) -> Index:
        keys = spec["key"].items() if isinstance(spec["key"], dict) else spec["key"]
        return Index(spec["name"], tuple((k, v) for k, v in keys), bool(spec.get("unique")), bool(spec.get("sparse")), spec.get("expireAfterSeconds"), spec.get("partialFilterExpression"), spec.get("collation"))

    @property
    def fields(self) -> list[str]:
        return [k for k, _ in self.keys]

    def describe(self) -> str:
        marks = [", ".join(f"{k}: {v}" for k, v in self.keys)]
        marks += ["unique"] * self.unique + ["sparse"] * self.sparse + ["partial"] * (self.partial_filter is not None)
        if self.expire_after_seconds is not None:
            marks.append(f"TTL {self.expire_after_seconds}s")
        if self.collation:
            marks.append(f"collation {self.collation.get('locale', '?')}")
        kinds = {v for _, v in self.keys if isinstance(v, str)}
        return f"{self.name} ({'; '.join(marks + sorted(kinds))})"


def replicable(specs: list[dict]) -> list[Index]:
    """All but the key's own index."""
    return [Index.of(s) for s in specs if s.get("name") != "_id_"]


def covered(df: DataFrame, index: Index) -> DataFrame:
    """The rows that the index holds."""
    if index.partial_filter:
        df = df.where(compile_filter(index.partial_filter, df.schema))
    if index.sparse:
        for f in index.fields:
            found = resolve(df.schema, f)
            df = df.where(found[0].isNotNull() if found else F.lit(False))
    return df


def violations(df: DataFrame, index: Index) -> DataFrame:
    """Key values that a unique index holds more than once, with their number."""
    keys = [(resolve(df.schema, f)[0] if resolve(df.schema, f) else F.lit(None)).alias(f"k{i}") for i, f in enumerate(index.fields)]
    rows = covered(df, index).select(*keys)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unexpired(df: DataFrame, index: Index, now=None) -> DataFrame:
    """The rows whose time to live has not passed."""
    found = resolve(df.schema, index.fields[0])
    if index.expire_after_seconds is None or found is None:
        return df
    now = F.current_timestamp() if now is None else F.lit(now)
    return df.where(found[0].isNull() | (found[0] + F.make_dt_interval(secs=F.lit(float(index.expire_after_seconds))) > now))


def replicate(spark: SparkSession, df: DataFrame, specs: list[dict], path: str | None = None) -> tuple[int, int, list[str]]:
    """Check every index on the loaded rows and keep the definitions; (good, failed, messages)."""
    good, errors = [], []
    for index in replicable(specs):
        try:
            if index.unique and violations(df, index).limit(1).count():
                raise ValueError("duplicate keys")
            good.append(index)
        except Exception as e:  # one bad definition does not stop the others
            errors.append(f"{index.describe()}: {e}")
    if path:
        rows = [(i.name, i.describe(), i.unique, i.sparse, i.expire_after_seconds) for i in good]
        spark.createDataFrame(rows, "name string, description string, unique boolean, sparse boolean, expire_after_seconds int").write.mode("overwrite").json(path)
    return len(good), len(errors), errors
