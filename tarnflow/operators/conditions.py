"""Conditions of transform steps: {field, operator, value} on the current document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.regex import java_pattern
from tarnflow.operators.filters import COMPARE, comparable, false_if_null, literal
from tarnflow.operators.paths import type_at, value_at

OPERATORS = ("$exists", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$regex")


class ConditionTypeError(TypeError):
    """A comparison of a field with a literal of another kind."""


def same(c: Column, kind: T.DataType | None, value) -> Column:
    if value is None or kind is None:
        return F.lit(value is None) if kind is None else c.isNull()
    return c.eqNullSafe(literal(kind, value)) if comparable(kind, value) else F.lit(False)


def condition(schema: T.StructType, spec: dict) -> Column:
    """The condition as a Column that is never null."""
    field, op, value = spec["field"], spec["operator"], spec.get("value")
    kind, c = type_at(schema, field), value_at(schema, field)
    if op not in OPERATORS:
        raise ValueError(f"unknown condition operator {op!r}")
    if op == "$exists":
        return c.isNotNull() if value is None or value else c.isNull()
    if op == "$eq":
        return same(c, kind, value)
    if op == "$ne":
        return ~same(c, kind, value)
    if op in ("$in", "$nin"):
        hit = F.lit(False)
        for v in value or []:
            hit = hit | same(c, kind, v)
        return hit if op == "$in" else ~hit
    if kind is None:
        return F.lit(False)
    if op == "$regex":
        return false_if_null(c.rlike(java_pattern(value))) if isinstance(kind, T.StringType) else F.lit(False)
    if not comparable(kind, value):
        raise ConditionTypeError(f"{field} ({kind.simpleString()}) cannot be compared with {value!r}")
    return false_if_null(getattr(c, COMPARE[op])(literal(kind, value)))
