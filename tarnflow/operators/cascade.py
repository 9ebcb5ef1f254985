"""Related rows across collections: a chain of semi-joins down the relationship tree.

Nothing is collected: each level's rows are a lazy ``left_semi`` join with its
parent's rows, so that Catalyst picks the join and prunes the keys' columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.filters import compile_filter, resolve
from tarnflow.operators.relationships import RelationshipGraph

Loader = Callable[[str], DataFrame]


@dataclass
class Cascade:
    root: str
    frames: dict[str, DataFrame]
    graph: RelationshipGraph

    def counts(self) -> dict[str, int]:
        """Rows by collection, in one query a collection; below an empty one all are empty."""
        out: dict[str, int] = {}
        for name, df in self.frames.items():
            up = self.graph.parent.get(name)
            out[name] = 0 if up and out.get(up.parent, 1) == 0 and name != self.root else df.count()
        return out

    def skipped(self, counts: dict[str, int] | None = None) -> list[str]:
        """Collections without a related row."""
        return [n for n, c in (counts or self.counts()).items() if not c and n != self.root]


def typed_ids(kind: T.DataType, ids: list) -> list:
    """Ids from text as the key column's type; ValueError for one that is none."""
    out = []
    for i in ids:
        if isinstance(kind, T.IntegralType):
            if not str(i).strip().lstrip("-").isdigit():
                raise ValueError(f"{i!r} is no {kind.simpleString()} id")
            out.append(int(i))
        else:
            out.append(str(i).strip())
    return out


def key_values(df: DataFrame, path: str, name: str = "__key") -> DataFrame:
    """The non-null values of a field, for a semi-join; elements of an array count each."""
    found = resolve(df.schema, path)
    if found is None:
        raise ValueError(f"no field {path!r}")
    c, kind = found
    rows = df.select((F.explode(c) if isinstance(kind, T.ArrayType) else c).alias(name))
    return rows.where(F.col(name).isNotNull())


def related(parent: DataFrame, child: DataFrame, parent_field: str, child_field: str) -> DataFrame:
    """The rows of ``child`` whose reference is the key of some row of ``parent``."""
    c, kind = resolve(child.schema, child_field) or (None, None)
    if c is None:
        raise ValueError(f"no field {child_field!r}")
    keys = key_values(parent, parent_field)
    if isinstance(kind, T.ArrayType):
        # each element is a reference of its own, so that the join is by equal keys; a row met twice comes once
        # (the rows are numbered before they are exploded)
        numbered = child.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__id"), F.array_distinct(c).alias("__refs"))
        each = numbered.select("__row", "__id", F.explode("__refs").alias("__ref"))
        return each.join(keys, F.col("__ref") == F.col("__key"), "left_semi").dropDuplicates(["__id"]).select("__row.*")
    return child.join(keys, c == F.col("__key"), "left_semi")


def orphans(parent: DataFrame, child: DataFrame, parent_field: str, child_field: str) -> DataFrame:
    """The rows of ``child`` whose reference no row of ``parent`` has."""
    c, _ = resolve(child.schema, child_field)
    return child.where(c.isNotNull()).join(key_values(parent, parent_field), c == F.col("__key"), "left_anti")


def cascade(graph: RelationshipGraph, load: Loader, root: str, *, ids: list | None = None, query: dict | None = None, key: str = "_id") -> Cascade:
    """The root's rows by id or filter, and all rows below that belong to them."""
    if (ids is None) == (query is None):
        raise ValueError("give either ids or a query")
    if graph.has_cycles():
        raise ValueError("the relationships form a cycle")
    df = load(root)
    if ids is not None:
        found = resolve(df.schema, key)
        if found is None:
            raise ValueError(f"{root} has no field {key!r}")
        start = df.where(found[0].isin(typed_ids(found[1], ids)))
    else:
        start = df.where(compile_filter(query, df.schema))
    frames = {root: start}
    for name in graph.descendants(root)[1:]:
        r = graph.parent[name]
        frames[name] = related(frames[r.parent], load(name), r.parent_field, r.child_field)
    return Cascade(root, frames, graph)
