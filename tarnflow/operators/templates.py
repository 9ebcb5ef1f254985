"""Values of transform steps: ``${path}`` placeholders in text, lists and documents."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.anonymize import as_text
from tarnflow.operators.paths import type_at, value_at

_HOLE = re.compile(r"\$\{([^}]+)\}")


def placeholder(schema: T.StructType, name: str) -> Column:
    if name == "now":
        return F.current_timestamp()
    if name == "null":
        return F.lit(None).cast("string")
    return value_at(schema, name) if type_at(schema, name) is not None else F.lit(None).cast("string")


def rendered(schema: T.StructType, value) -> Column:
    """A literal with its placeholders filled: alone typed, within text as text (null as empty)."""
    if isinstance(value, str):
        if whole := _HOLE.fullmatch(value):
            return placeholder(schema, whole[1].strip())
        pieces, at = [], 0
        for m in _HOLE.finditer(value):
            name = m[1].strip()
            kind = type_at(schema, name)
            text = placeholder(schema, name)
            text = as_text(text, kind) if kind is not None else text.cast("string")
            pieces += [F.lit(value[at : m.start()]), F.coalesce(text, F.lit(""))]
            at = m.end()
        return F.concat(*pieces, F.lit(value[at:])) if pieces else F.lit(value)
    if isinstance(value, dict):
        return F.struct(*(rendered(schema, v).alias(k) for k, v in value.items()))
    if isinstance(value, list):
        return F.array(*(rendered(schema, v) for v in value))
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, (dt.datetime, dt.date, int, float, bool, bytes)):
        return F.lit(value)
    raise TypeError(f"no literal of type {type(value).__name__}")
