"""The transform pipeline: field steps in order, then anonymization, in one plan.

``Pipeline(steps, error_mode).apply(df)`` returns a Result whose ``df`` has the
transformed rows. A step may fail on a row (adding a field that has a value,
renaming onto one, writing below a value that is no document). In ``skip`` mode
such a row keeps its original fields through the field steps; in ``fail`` mode
the query raises, whatever columns are read. Anonymization of a field that no
document can have is an error when the plan is made, unless the step says
``optional``: a misspelt field does not pass in the clear. Counts of what each step did come from an ``Observation`` of
the same pass.
"""

from __future__ import annotations

import secrets
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.regex import java_pattern, java_replacement
from tarnflow.operators.anonymize import anonymized, operator, text_kind
from tarnflow.operators.conditions import ConditionTypeError, condition
from tarnflow.operators.paths import expand, mapped, put, quoted, type_at, value_at, without
from tarnflow.operators.templates import rendered

KINDS = ("add_field", "set_field", "remove_field", "rename_field", "copy_field", "regex_replace", "anonymize")
NEEDS = {"add_field": ("field", "value"), "set_field": ("field", "value"), "remove_field": ("field",), "rename_field": ("from_field", "to_field"), "copy_field": ("from_field", "to_field"), "regex_replace": ("field", "pattern", "replacement"), "anonymize": ("field", "operator")}
FAILED, ORIGINAL = "__failed", "__original_"


class TransformError(ValueError):
    """A step that is wrong for every row, or in ``fail`` mode for some row."""


def checked(step: dict) -> dict:
    """The step itself; ValueError if its parts are missing or wrong."""
    kind = step.get("type")
    if kind not in KINDS:
        raise ValueError(f"unknown transform type {kind!r}")
    if lost := [k for k in NEEDS[kind] if step.get(k) is None and k != "value" or k not in step]:
        raise ValueError(f"{kind} needs {', '.join(lost)}")
    if kind == "regex_replace":
        java_pattern(step["pattern"])
    if kind == "anonymize":
        operator(step["operator"], step.get("params"))
    return step


@dataclass
class Result:
    df: DataFrame
    observation: Observation
    steps: list[dict]

    def statistics(self) -> dict:
        """After an action on ``df``: documents, and what the steps did by kind."""
        got = self.observation.get
        ops: dict[str, dict] = {}
        for i, s in enumerate(self.steps):
            op = ops.setdefault(s["type"], {"fields_configured": 0, "fields_processed": 0})
            op["fields_configured"] += len(s["field"]) if isinstance(s.get("field"), list) else 1
            op["fields_processed"] += got[f"applied_{i}"] or 0
        n = range(len(self.steps))
        return {
            "documents_processed": got["documents"] - (got["failed"] or 0),
            "documents_failed": got["failed"] or 0,
            "transforms_applied": sum(got[f"applied_{i}"] or 0 for i in n),
            "transforms_skipped": sum(got[f"skipped_{i}"] or 0 for i in n),
            "operations": ops,
        }


class Pipeline:
    def __init__(self, steps: list[dict], error_mode: str = "skip"):
        if error_mode not in ("skip", "fail"):
            raise ValueError("error_mode must be skip or fail")
        self.steps = [checked(s) for s in steps]
        # anonymization comes after all other steps, wherever it stands
        self.ordered = [s for s in self.steps if s["type"] != "anonymize"] + [s for s in self.steps if s["type"] == "anonymize"]
        self.error_mode = error_mode
        # one for all steps, so that equal values stay equal across fields; it is not kept
        self.salt = secrets.token_hex(16)

    def apply(self, df: DataFrame) -> Result:
        source = df
        fields = [s for s in self.ordered if s["type"] != "anonymize"]
        out, can_fail = self._fields(df.withColumn(FAILED, F.lit(False)), fields, False)
        if can_fail:
            # rows may fail: the originals go along, and no column leaves before the end
            kept = df.select("*", *(quoted(c).alias(ORIGINAL + c) for c in df.columns), F.lit(False).alias(FAILED))
            out, _ = self._fields(kept, fields, True)
            out = self._settle(source, out)
        df = out
        for i, step in enumerate(self.ordered[len(fields) :], len(fields)):
            df = self._anonymize(df, i, step)
        observed = Observation(f"transform-{uuid.uuid4().hex}")
        sums = [F.sum(quoted(f"__{what}_{i}").cast("bigint")).alias(f"{what}_{i}") for i in range(len(self.ordered)) for what in ("applied", "skipped")]
        df = df.observe(observed, F.count(F.lit(1)).alias("documents"), F.sum(F.col(FAILED).cast("bigint")).alias("failed"), *sums)
        return Result(df.select(*(quoted(f.name) for f in visible(df.schema).fields)), observed, self.ordered)

    def _fields(self, df: DataFrame, steps: list[dict], keep: bool) -> tuple[DataFrame, bool]:
        can_fail = False
        for i, step in enumerate(steps):
            df, may = self._field_step(df, i, step, keep)
            can_fail |= may
        return df, can_fail

    # -- field steps -------------------------------------------------------

    def _counted(self, df: DataFrame, i: int, applied: Column, skipped: Column, changes: dict[str, Column | None], bad: Column | None) -> DataFrame:
        """One projection: the changed columns (None: dropped), the counts, and the failures so far."""
        out = [quoted(c) if c not in changes else changes[c].alias(c) for c in df.columns if c != FAILED and not (c in changes and changes[c] is None)]
        out += [c.alias(n) for n, c in changes.items() if n not in df.columns and c is not None]
        failed = F.col(FAILED) if bad is None else F.col(FAILED) | F.coalesce(bad, F.lit(False))
        return df.select(*out, applied.alias(f"__applied_{i}"), skipped.alias(f"__skipped_{i}"), failed.alias(FAILED))

    def _field_step(self, df: DataFrame, i: int, step: dict, keep: bool) -> tuple[DataFrame, bool]:
        schema, kind = visible(df.schema), step["type"]
        live = ~F.col(FAILED)
        try:
            when = condition(schema, step["condition"]) if step.get("condition") else None
        except ConditionTypeError as e:
            if self.error_mode == "fail":
                raise TransformError(str(e)) from e
            return self._counted(df, i, F.lit(0), F.lit(0), {}, F.lit(True)), True
        on = live if when is None else live & when
        skipped = (live & ~when).cast("int") if when is not None else F.lit(0)
        always = when is None and not keep
        if kind in ("add_field", "set_field"):
            path = step["field"]
            bad = on & value_at(schema, path).isNotNull() if kind == "add_field" and type_at(schema, path) is not None else None
            go = on if bad is None else on & ~bad
            change, blocked = self._write(df, path, rendered(schema, step["value"]), go, always and bad is None)
            bad = _either(bad, blocked)
            return self._counted(df, i, _done(on, bad), skipped, change, bad), bad is not None
        if kind == "remove_field":
            paths = step["field"] if isinstance(step["field"], list) else [step["field"]]
            df = self._counted(df, i, on.cast("int") * len(paths), skipped, {}, None)
            # the condition is that of the document before any of the paths has gone
            df = df.withColumn(f"__on_{i}", on)
            for path in paths:
                now = visible(df.schema)
                if type_at(now, path) is not None:
                    df = self._changed(df, self._drop(now, path) if always else self._null(now, path, F.col(f"__on_{i}")))
            return df.drop(f"__on_{i}"), False
        if kind in ("rename_field", "copy_field"):
            return self._move(df, i, step, on, skipped, always)
        path = step["field"]
        if not isinstance(type_at(schema, path), T.StringType):
            return self._counted(df, i, F.lit(0), skipped, {}, None), False
        old = value_at(schema, path)
        new = F.regexp_replace(old, F.lit(java_pattern(step["pattern"])), F.lit(java_replacement(step["replacement"])))
        first, *rest = path.split(".")
        change = {first: mapped(quoted(first), schema[first].dataType, rest, lambda c, k: F.when(on, new).otherwise(c))}
        return self._counted(df, i, (on & old.isNotNull()).cast("int"), skipped, change, None), False

    def _changed(self, df: DataFrame, changes: dict[str, Column | None]) -> DataFrame:
        return df.select(*(changes[c].alias(c) if c in changes else quoted(c) for c in df.columns if c not in changes or changes[c] is not None))

    def _move(self, df: DataFrame, i: int, step: dict, on: Column, skipped: Column, always: bool) -> tuple[DataFrame, bool]:
        schema, source, target = visible(df.schema), step["from_field"], step["to_field"]
        if type_at(schema, source) is None or source == target:
            return self._counted(df, i, F.lit(0), skipped, {}, None), False
        value, has_target = value_at(schema, source), type_at(schema, target) is not None
        on = on & value.isNotNull()
        bad = on & value_at(schema, target).isNotNull() if has_target and not step.get("overwrite") else None
        change, blocked = self._write(df, target, value, on if bad is None else on & ~bad, False)
        bad = _either(bad, blocked)
        df = self._counted(df, i, _done(on, bad), skipped, change, bad)
        if step["type"] == "rename_field":
            now = visible(df.schema)
            # if every row that had a value has moved it, the source is empty and goes
            gone = self._drop(now, source) if always and bad is None else self._null(now, source, F.col(f"__applied_{i}") == 1)
            df = self._changed(df, gone)
        return df, bad is not None

    def _write(self, df: DataFrame, path: str, value: Column, on: Column, always: bool) -> tuple[dict[str, Column], Column | None]:
        """The top-level column of ``path`` with ``value`` there, where ``on`` holds; and where it cannot be."""
        schema = visible(df.schema)
        first, *rest = path.split(".")
        exists, kind = first in schema.fieldNames(), type_at(schema, path)
        if kind is None:
            new = value if always else F.when(on, value)
        elif always:
            new = value
        else:
            new_kind = df.select(value.alias("v")).schema["v"].dataType
            old = value_at(schema, path)
            if new_kind == kind or isinstance(new_kind, T.NumericType) and isinstance(kind, T.NumericType):
                new = F.when(on, value).otherwise(old)
            else:  # a column has one type: both as text
                new = F.when(on, value.cast("string")).otherwise(old.cast("string"))
        if not rest:
            return {first: new}, None
        made, bad = put(quoted(first) if exists else None, schema[first].dataType if exists else None, rest, new, on)
        return {first: made}, bad

    def _drop(self, schema: T.StructType, path: str) -> dict[str, Column | None]:
        first, *rest = path.split(".")
        return {first: without(quoted(first), schema[first].dataType, rest) if rest else None}

    def _null(self, schema: T.StructType, path: str, on: Column) -> dict[str, Column | None]:
        first, *rest = path.split(".")
        return {first: mapped(quoted(first), schema[first].dataType, rest, lambda c, k: F.when(~on, c))}

    def _settle(self, source: DataFrame, df: DataFrame) -> DataFrame:
        """Failed rows as they came, or an error."""
        schema = visible(df.schema)
        own = [quoted(c) for c in df.columns if c.startswith("__") and not c.startswith(ORIGINAL)]
        if self.error_mode == "fail":
            # as a filter it stays whatever columns are read
            df = df.where(F.assert_true(~F.col(FAILED), "a transform failed on a document").isNull())
            return df.select(*(quoted(f.name) for f in schema.fields), *own)
        out = []
        for f in schema.fields:
            if f.name in source.columns:
                out.append(_choose(F.col(FAILED), quoted(ORIGINAL + f.name), source.schema[f.name].dataType, quoted(f.name), f.dataType).alias(f.name))
            else:
                out.append(F.when(~F.col(FAILED), quoted(f.name)).alias(f.name))
        return df.select(*out, *own)

    # -- anonymization -----------------------------------------------------

    def _anonymize(self, df: DataFrame, i: int, step: dict) -> DataFrame:
        schema = visible(df.schema)
        f = operator(step["operator"], step.get("params"), self.salt)
        when = condition(schema, step["condition"]) if step.get("condition") else None
        on = F.lit(True) if when is None else when
        changes: dict[str, Column] = {}
        paths = expand(schema, step["field"])
        if not paths:
            if not step.get("optional"):
                raise TransformError(f"no field {step['field']!r} to anonymize; say optional if documents may lack it")
            return df.select("*", F.lit(0).alias(f"__applied_{i}"), F.lit(0).alias(f"__skipped_{i}"))
        for path in paths:
            first, *rest = path.split(".")
            c = changes.get(first, quoted(first))

            def change(x: Column, k: T.DataType) -> Column:
                hidden = anonymized(x, k, f)
                return hidden if when is None else F.when(on, hidden).otherwise(x.cast(text_kind(k)))

            def entry(x: Column, k: T.DataType, below: list[str]) -> Column:
                return mapped(x, k, below, lambda v, vk: v.cast(text_kind(vk)), entry)

            if first in changes:  # several leaves of one column: the type has changed below
                df = df.withColumn(first, c)
                schema = visible(df.schema)
                c = quoted(first)
            changes[first] = mapped(c, schema[first].dataType, rest, change, entry)
        out = [changes[c].alias(c) if c in changes else quoted(c) for c in df.columns]
        return df.select(*out, on.cast("int").alias(f"__applied_{i}"), (~on).cast("int").alias(f"__skipped_{i}"))


def visible(schema: T.StructType) -> T.StructType:
    """The document's fields, without the pipeline's own columns."""
    return T.StructType([f for f in schema.fields if not f.name.startswith("__")])


def _either(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a | b


def _done(on: Column, bad: Column | None) -> Column:
    return (on if bad is None else on & ~F.coalesce(bad, F.lit(False))).cast("int")


def _choose(failed: Column, before: Column, before_kind: T.DataType, now: Column, now_kind: T.DataType) -> Column:
    """The original for failed rows; both as one type (text if they differ otherwise)."""
    if before_kind == now_kind:
        return F.when(failed, before).otherwise(now)
    if isinstance(before_kind, T.StructType) and isinstance(now_kind, T.StructType):
        names = list(dict.fromkeys([*before_kind.fieldNames(), *now_kind.fieldNames()]))
        parts = []
        for n in names:
            b = before.getField(n) if n in before_kind.fieldNames() else None
            a = now.getField(n) if n in now_kind.fieldNames() else None
            if a is None:
                parts.append(F.when(failed, b).alias(n))
            elif b is None:
                parts.append(F.when(~failed, a).alias(n))
            else:
                parts.append(_choose(failed, b, before_kind[n].dataType, a, now_kind[n].dataType).alias(n))
        return F.when(F.when(failed, before.isNotNull()).otherwise(now.isNotNull()), F.struct(*parts))
    return F.when(failed, before.cast("string")).otherwise(now.cast("string"))
