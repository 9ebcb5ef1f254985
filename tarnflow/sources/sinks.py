"""Write dispositions: merge (upsert by key), append (new keys only) and replace.

A table is written beside its old version and then swapped in by renames, so
that readers see one or the other, and a table may be read while it is
replaced. Merging rewrites the table; partition a large one and merge by
partition, or use a table format with row-level commits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.operators.filters import resolve
from tarnflow.sources.catalog import exists, filesystem

DISPOSITIONS = ("merge", "append", "replace")


class DuplicateKeyError(ValueError):
    """Append met a key that is there already."""


def latest(rows: DataFrame, key: str, cursor: str | None = None) -> DataFrame:
    """One row a key: that with the greatest cursor, which may be a path (the rest of the row breaks ties)."""
    found = resolve(rows.schema, cursor) if cursor else None
    order = [found[0].desc_nulls_last()] if found else []
    rows = rows.where(F.assert_true(F.col(key).isNotNull(), f"a row to merge has no {key}").isNull())
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*rows.columns))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged(target: DataFrame, rows: DataFrame, key: str, cursor: str | None = None) -> DataFrame:
    """``target`` with ``rows`` in place of or beside its own, whole documents by key.

    A row without a key is an error: merged twice, it would be there twice.
    """
    new = latest(rows, key, cursor)
    return target.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def duplicates(target: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """The keys of ``rows`` that occur twice in it or are in ``target``, with how often."""
    own = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull())
    if target is None:
        return own.where("n > 1")
    there = target.select(F.col(key).alias("__k"), F.lit(1).alias("__there")).distinct()
    met = own.join(there, F.col(key) == F.col("__k"), "left")
    return met.where("n > 1 or __there = 1").select(key, (F.col("n") + F.coalesce("__there", F.lit(0))).alias("n"))


def swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write to a new place and put it where ``path`` is."""
    fs, target = filesystem(spark, path)
    parent, name, run = target.getParent().toString(), target.getName(), uuid.uuid4().hex[:12]
    staged, old = f"{parent}/_staging-{name}-{run}", f"{parent}/_old-{name}-{run}"
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    try:
        write(staged)
        had = fs.exists(target)
        if had and not fs.rename(target, to(old)):
            raise OSError(f"cannot move {path} away")
        if not fs.rename(to(staged), target):
            if had:
                fs.rename(to(old), target)
            raise OSError(f"cannot put the new {path} in place")
        fs.delete(to(old), True)
    finally:
        fs.delete(to(staged), True)
    spark.catalog.refreshByPath(path)


def write(rows: DataFrame, path: str, disposition: str, key: str = "_id", cursor: str | None = None, format: str = "parquet", options: dict | None = None) -> None:
    """Write ``rows`` to the table at ``path``. Replace with no rows leaves an empty table."""
    if disposition not in DISPOSITIONS:
        raise ValueError(f"disposition must be one of {', '.join(DISPOSITIONS)}")
    spark = rows.sparkSession
    there = exists(spark, path)
    options = options or {}  # those that the table is read with (a CSV table's header, say)
    load = lambda: spark.read.format(format).options(**options).load(path)
    store = lambda df: swap(spark, path, lambda p: df.write.format(format).options(**options).save(p))
    if disposition == "replace":
        store(rows)
    elif disposition == "merge":
        store(merged(load(), rows, key, cursor) if there else latest(rows, key, cursor))
    else:
        target = load() if there else None
        twice = duplicates(target, rows, key).limit(1).collect()
        if twice:
            raise DuplicateKeyError(f"append met key {twice[0][0]!r} more than once; use merge to update rows")
        rows.write.format(format).options(**options).mode("append").save(path)


def summarize_errors(errors: DataFrame) -> DataFrame:
    """code, n, message from (code, message, pos): a line for each code, most frequent first.

    The message is the first one's first line, without its key values, at most 200 characters.
    """
    return errors.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min_by(short_message(F.col("message")), "pos").alias("message")).orderBy(F.desc("n"), "code")


def short_message(c: Column) -> Column:
    return F.left(F.substring_index(F.regexp_replace(c, "dup key: \\{[^}]*\\}", "dup key: { ... }"), "\n", 1), F.lit(200))


def error_text(errors: list[tuple[int, str]]) -> str:
    """The same for a few errors at hand, as one text."""
    by_code: dict[int, list[str]] = {}
    for code, message in errors:
        by_code.setdefault(code, []).append(message)
    lines = []
    for code, messages in sorted(by_code.items(), key=lambda x: (-len(x[1]), x[0])):
        first = re.sub(r"dup key: \{[^}]*\}", "dup key: { ... }", messages[0]).split("\n")[0][:200]
        lines.append(f"code {code}: {len(messages)} error(s), e.g. {first}")
    return "; ".join(lines)
