"""Document filters in JSON, compiled to one Catalyst predicate.

``compile_filter({"status": "active", "age": {"$gte": 18}}, df.schema)`` is a
Column for ``where``. Plain conjunctions stay bare, so that the scan can push
them down; null counts as false where a predicate is negated or used as a value.

An array field satisfies a predicate if any element does, or (for equality)
if the whole array does. A value is comparable with literals of its own kind
only; others do not match.
"""

from __future__ import annotations

import datetime as dt
import decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.regex import java_pattern
from tarnflow.operators.paths import field_of, quoted

COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
TYPES = {
    "string": T.StringType, "bool": T.BooleanType, "date": (T.TimestampType, T.TimestampNTZType, T.DateType), "double": (T.DoubleType, T.FloatType), "int": (T.IntegerType, T.ShortType, T.ByteType), "long": T.LongType,
    "decimal": T.DecimalType, "array": T.ArrayType, "object": (T.StructType, T.MapType), "objectId": T.StringType, "number": T.NumericType, "binData": T.BinaryType, "null": T.NullType,
}


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Value and type at a path. Arrays of documents give the array of their values."""
    first, *rest = path.split(".")
    f = field_of(schema, first)
    return descend(quoted(first), f.dataType, rest) if f else None


def descend(c: Column, kind: T.DataType, rest: list[str]) -> tuple[Column, T.DataType] | None:
    """The same below a value."""
    for part in rest:
        depth = 0
        inner = kind
        while isinstance(inner, T.ArrayType):
            inner, depth = inner.elementType, depth + 1
        if isinstance(inner, T.MapType):
            return (c.getItem(part), inner.valueType) if not depth else None
        f = field_of(inner, part)
        if f is None:
            return None
        for _ in range(depth - 1):
            c = F.flatten(c)
        c = F.transform(c, _getter(part)) if depth else c.getField(part)
        kind = T.ArrayType(f.dataType) if depth else f.dataType
    return c, kind


def _getter(name: str):
    return lambda e: e.getField(name)


def comparable(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float, decimal.Decimal)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, (dt.datetime, dt.date)):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if isinstance(value, str):
        return isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType))
    return False


def literal(kind: T.DataType, value) -> Column:
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.lit(value.replace("Z", "+00:00"))).cast(kind)
    return F.lit(value)


def any_of(c: Column, kind: T.DataType, test) -> Column:
    """``test`` on a value, or on any element of an array."""
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda e: false_if_null(any_of(e, kind.elementType, test)))
    return test(c, kind)


def equals(c: Column, kind: T.DataType, value) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(value, list):
        if isinstance(kind, T.ArrayType) and all(comparable(kind.elementType, v) for v in value):
            return c == F.array(*(literal(kind.elementType, v) for v in value)).cast(kind)
        return F.lit(False)
    if isinstance(value, dict):
        if not isinstance(kind, T.StructType) or sorted(value) != sorted(f.name for f in kind.fields):
            return F.lit(False)
        return both([equals(c.getField(k), field_of(kind, k).dataType, v) for k, v in value.items()])
    return any_of(c, kind, lambda x, k: x == literal(k, value) if comparable(k, value) else F.lit(False))


def within(c: Column, kind: T.DataType, values: list) -> Column:
    if not isinstance(values, (list, tuple)):
        raise ValueError("$in and $nin take a list")
    scalars = [v for v in values if v is not None and not isinstance(v, (list, dict))]

    def test(x: Column, k: T.DataType) -> Column:
        fit = [v for v in scalars if comparable(k, v)]
        if not fit:
            return F.lit(False)
        return x.isin(fit) if isinstance(k, (T.StringType, T.NumericType, T.BooleanType)) else x.isin([literal(k, v) for v in fit])

    parts = [any_of(c, kind, test)] if scalars else []
    parts += [equals(c, kind, v) for v in values if isinstance(v, (list, dict))]
    if None in values:
        parts.append(c.isNull())
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def of_type(c: Column, kind: T.DataType, names) -> Column:
    names = names if isinstance(names, list) else [names]
    if unknown := [n for n in names if n not in TYPES]:
        raise ValueError(f"unknown type {unknown[0]!r}")
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    hit = any(isinstance(k, TYPES[n]) for n in names for k in (kind, inner))
    return c.isNotNull() if hit else F.lit(False)


def test(schema: T.StructType, path: str, spec) -> Column:
    """The predicate of one field: a value, or a document of operators."""
    return predicate(resolve(schema, path), spec)


def predicate(found: tuple[Column, T.DataType] | None, spec) -> Column:
    """The predicate on a value of known type (None: an absent field)."""
    c, kind = found if found else (F.lit(None).cast("string"), T.StringType())
    if not isinstance(spec, dict) or not any(k.startswith("$") for k in spec):
        return equals(c, kind, spec) if found else F.lit(spec is None)
    parts = []
    for op, v in spec.items():
        if op == "$options":
            continue
        if not found and op in ("$gt", "$gte", "$lt", "$lte", "$regex", "$all", "$size", "$elemMatch", "$mod", "$type"):
            parts.append(F.lit(False))
        elif op == "$eq":
            parts.append(equals(c, kind, v))
        elif op == "$ne":
            simple = v is not None and not isinstance(kind, T.ArrayType) and comparable(kind, v)
            parts.append(~c.eqNullSafe(literal(kind, v)) if simple else ~false_if_null(equals(c, kind, v)))
        elif op in COMPARE:
            parts.append(any_of(c, kind, lambda x, k, op=op, v=v: getattr(x, COMPARE[op])(literal(k, v)) if comparable(k, v) else F.lit(False)))
        elif op == "$in":
            parts.append(within(c, kind, v))
        elif op == "$nin":
            parts.append(~false_if_null(within(c, kind, v)))
        elif op == "$exists":
            parts.append(c.isNotNull() if v else c.isNull())
        elif op == "$regex":
            flags = "".join(f for f in spec.get("$options", "") if f in "imsx")
            pattern = java_pattern(v).replace("(?U)", f"(?U{flags})", 1)
            parts.append(any_of(c, kind, lambda x, k, p=pattern: x.rlike(p) if isinstance(k, T.StringType) else F.lit(False)))
        elif op == "$all":
            parts.append(both([equals(c, kind, x) for x in v]) if v else F.lit(False))
        elif op == "$size":
            parts.append(F.size(c) == F.lit(v) if isinstance(kind, T.ArrayType) else F.lit(False))
        elif op == "$mod":
            d, r = v
            parts.append(any_of(c, kind, lambda x, k, d=d, r=r: x.cast("bigint") % d == r if isinstance(k, T.NumericType) else F.lit(False)))
        elif op == "$type":
            parts.append(of_type(c, kind, v))
        elif op == "$not":
            parts.append(~false_if_null(predicate(found, v)))
        elif op == "$elemMatch":
            parts.append(elem_match(c, kind, v))
        else:
            raise ValueError(f"unknown filter operator {op!r}")
    return both(parts)


def elem_match(c: Column, kind: T.DataType, spec: dict) -> Column:
    """Some element meets all of ``spec``: operators for values, a filter for documents."""
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    element = kind.elementType
    if isinstance(element, T.StructType) and not any(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec):
        return F.exists(c, lambda e: false_if_null(_inside(spec, element, e)))
    return F.exists(c, lambda e: false_if_null(predicate((e, element), spec)))


def _inside(spec: dict, kind: T.StructType, e: Column) -> Column:
    """A filter over the fields of the lambda variable ``e``."""
    parts = []
    for key, v in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts.append(combine(key, [_inside(x, kind, e) for x in v]))
        else:
            first, *rest = key.split(".")
            f = field_of(kind, first)
            parts.append(predicate(descend(e.getField(first), f.dataType, rest) if f else None, v))
    return both(parts)


def combine(op: str, parts: list[Column]) -> Column:
    if not parts:
        raise ValueError(f"{op} takes a list of filters")
    if op == "$and":
        return both(parts)
    either = reduce(lambda a, b: a | b, parts)
    return either if op == "$or" else ~false_if_null(either)


def compile_filter(spec: dict | None, schema: T.StructType) -> Column:
    """The predicate of a filter document; an empty one is true."""
    parts = []
    for key, v in (spec or {}).items():
        if key in ("$and", "$or", "$nor"):
            parts.append(combine(key, [compile_filter(x, schema) for x in v]))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key!r}")
        else:
            parts.append(test(schema, key, v))
    return both(parts)


def matched(df, spec: dict | None):
    """The rows of ``df`` that a filter document selects."""
    return df.where(compile_filter(spec, df.schema)) if spec else df


def incremental(schema: T.StructType, cursor: str | None, last, spec: dict | None = None) -> Column:
    """(cursor absent or beyond ``last``) and the filter; without a usable ``last``, the filter."""
    own = compile_filter(spec, schema)
    found = resolve(schema, cursor) if cursor else None
    if found is None or last is None or not comparable(found[1], last):
        return own
    c, kind = found
    return (c.isNull() | (c > literal(kind, last))) & own if spec else c.isNull() | (c > literal(kind, last))
