"""Dotted field paths, resolved against a schema: read, write, drop, list and match.

A path passes through arrays only where the caller says so; otherwise a path
that meets an array is absent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def field_of(kind: T.DataType, name: str) -> T.StructField | None:
    return next((f for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path, None if it is absent or behind an array."""
    kind: T.DataType = schema
    for part in path.split("."):
        f = field_of(kind, part)
        if f is None:
            return None
        kind = f.dataType
    return kind


def value_at(schema: T.StructType, path: str) -> Column:
    """The value at a path; null where it is absent."""
    if type_at(schema, path) is None:
        return F.lit(None)
    first, *rest = path.split(".")
    c = quoted(first)
    for part in rest:
        c = c.getField(part)
    return c


def leaves(schema: T.StructType, through_arrays: bool = True) -> list[str]:
    """All paths to values that are no documents, in schema order."""

    def walk(kind: T.DataType, prefix: str) -> list[str]:
        while through_arrays and isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
        return [prefix]

    return walk(schema, "")


def all_paths(schema: T.StructType, depth: int | None = None) -> list[str]:
    """All paths, documents included, without array indices."""
    out: list[str] = []

    def walk(kind: T.DataType, prefix: str) -> None:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType) and (depth is None or not prefix or prefix.count(".") < depth):
            for f in kind.fields:
                path = f"{prefix}.{f.name}" if prefix else f.name
                out.append(path)
                walk(f.dataType, path)

    walk(schema, "")
    return out


def wildcard_regex(pattern: str) -> str:
    """A pattern whose ``*`` parts occur in order anywhere in the path."""
    if "*" not in pattern:
        return f"^{re.escape(pattern)}$"
    return "(?s)" + ".*".join(re.escape(p) for p in pattern.split("*"))


def matches(path: str, pattern: str) -> bool:
    return re.search(wildcard_regex(pattern), path) is not None


def reaches(kind: T.DataType, path: str) -> bool:
    """Whether a path leads to something, through documents, arrays and maps (of any keys)."""
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.MapType):
            kind = kind.valueType
            continue
        f = field_of(kind, part)
        if f is None:
            return False
        kind = f.dataType
    return True


def expand(schema: T.StructType, pattern: str) -> list[str]:
    """The leaves that a field pattern names; a plain path names itself, if it leads to something.

    A map is a leaf: a pattern that names its entries names all of them.
    """
    if "*" not in pattern:
        return [pattern] if reaches(schema, pattern) else []
    return [p for p in leaves(schema) if matches(p, pattern) or matches(p + ".*", pattern) and isinstance(kind_of(schema, p), T.MapType)]


def kind_of(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path, of the elements where it passes through or ends at arrays."""
    kind: T.DataType = schema
    for part in path.split("."):
        f = field_of(kind, part)
        if f is None:
            return None
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
    return kind


def normalize(path: Column) -> Column:
    """A flattened path without its array indices."""
    dotted = F.regexp_replace(F.regexp_replace(path, "\\[\\d+\\]\\.?", "."), "\\.{2,}", ".")
    return F.regexp_replace(dotted, "^\\.+|\\.+$", "")


def struct_of(fields: list[tuple[str, Column]]) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields))


def put(c: Column | None, kind: T.DataType | None, rest: list[str], value: Column, on: Column) -> tuple[Column, Column | None]:
    """``c`` with ``value`` at ``rest`` where ``on`` holds, and where that fails (None: nowhere).

    Missing documents on the way are made; a value on the way that is no
    document is left alone, and is a failure.
    """
    if not rest:
        return value, None
    name, *deeper = rest
    if kind is not None and not isinstance(kind, T.StructType):
        return c, on & c.isNotNull()
    fields = kind.fields if kind is not None else []
    old = field_of(kind, name) if kind is not None else None
    inner, bad = put(c.getField(name) if old else None, old.dataType if old else None, deeper, value, on)
    parts = [(f.name, inner if f.name == name else c.getField(f.name)) for f in fields]
    if old is None:
        parts.append((name, inner))
    made = struct_of(parts)
    return F.when(on if c is None else on | c.isNotNull(), made), bad


def without(c: Column, kind: T.DataType, rest: list[str]) -> Column | None:
    """``c`` without the field at ``rest``; None if nothing would be left of it."""
    if not isinstance(kind, T.StructType) or field_of(kind, rest[0]) is None:
        return c
    f = field_of(kind, rest[0])
    inner = without(c.getField(f.name), f.dataType, rest[1:]) if len(rest) > 1 else None
    parts = [(g.name, inner if g.name == f.name else c.getField(g.name)) for g in kind.fields if g.name != f.name or inner is not None]
    return F.when(c.isNotNull(), struct_of(parts)) if parts else None


def mapped(c: Column, kind: T.DataType, rest: list[str], change: Callable[[Column, T.DataType], Column], entry: Callable[[Column, T.DataType, list[str]], Column] | None = None) -> Column:
    """``c`` with ``change`` at ``rest``, through documents and arrays.

    With ``entry`` it goes through maps as well; ``entry`` gives the other
    entries' values the type that ``change`` makes.
    """
    if isinstance(kind, T.ArrayType) and (rest or isinstance(kind.elementType, (T.ArrayType, T.StructType))):
        return F.transform(c, lambda e: mapped(e, kind.elementType, rest, change, entry))
    if not rest:
        return change(c, kind)
    if isinstance(kind, T.MapType) and entry is not None:
        return F.transform_values(c, lambda k, v: F.when(k == rest[0], mapped(v, kind.valueType, rest[1:], change, entry)).otherwise(entry(v, kind.valueType, rest[1:])))
    f = field_of(kind, rest[0])
    if f is None:
        return c
    parts = [(g.name, mapped(c.getField(g.name), g.dataType, rest[1:], change, entry) if g.name == f.name else c.getField(g.name)) for g in kind.fields]
    return F.when(c.isNotNull(), struct_of(parts))
