"""Detection of personal values: a table of recognizers, the long form of documents, statistics.

Documents become rows (doc, path, pos, value), one for each string leaf and array
element; every recognizer is one expression on ``value``. The best entity of a
value wins (the first of the table among equals). Names of persons and places
need a language model: ``register_recognizer`` takes a Column function, which may
wrap a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions.regex import java_pattern
from tarnflow.operators.paths import matches, quoted


@dataclass(frozen=True)
class Recognizer:
    """Patterns with scores; a validator confirms a match, context words raise its score."""

    entity: str
    patterns: tuple[tuple[str, float], ...] = ()
    validator: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    deny_list: tuple[str, ...] = ()
    test: Callable[[Column], Column] | None = field(default=None, compare=False)

    def score(self, value: Column, path: Column | None = None) -> Column:
        """The score of the best pattern, 0.0 if none fits."""
        if self.test is not None:
            return F.coalesce(self.test(value), F.lit(0.0))
        best = F.lit(0.0)
        for pattern, score in self.patterns:
            hit = F.regexp_extract(value, pattern, 0)
            ok = hit != ""
            if self.validator is not None:
                ok = ok & F.coalesce(self.validator(hit), F.lit(False))
            best = F.greatest(best, F.when(ok, F.lit(score)).otherwise(F.lit(0.0)))
        if self.deny_list:
            words = "|".join(f"\\Q{w}\\E" for w in self.deny_list)
            best = F.greatest(best, F.when(value.rlike(f"(?<!\\w)(?:{words})(?!\\w)"), F.lit(1.0)).otherwise(F.lit(0.0)))
        if self.context:
            near = value if path is None else F.concat_ws(" ", path, value)
            words = "|".join(f"\\Q{w}\\E" for w in self.context)
            best = F.when((best > 0) & near.rlike(f"(?i)(?<![a-z])(?:{words})(?![a-z])"), F.least(F.lit(1.0), best + 0.35)).otherwise(best)
        return best


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", ""))


def octets(c: Column) -> Column:
    return F.forall(F.split(c, "\\."), lambda p: F.try_element_at(F.array(p.cast("int")), F.lit(1)) <= 255)


def iban_check(c: Column) -> Column:
    """ISO 7064 mod 97: the first four characters move to the end, letters count 10 to 35."""
    text = F.upper(F.regexp_replace(c, "\\s", ""))
    moved = F.concat(F.substring(text, 5, 64), F.left(text, F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    step = lambda acc, x: (acc * F.when(value(x) > 9, F.lit(100)).otherwise(F.lit(10)) + value(x)) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


#: What the names of fields and the text around a number call it.
SAYS_SSN = ("ssn", "ss#", "social security", "taxpayer id")
SAYS_SIN = ("sin", "nas", "social insurance", "assurance sociale")
SAYS_TAX = ("tin", "bn", "tax id", "tax number", "business number", "gst", "hst")
SAYS_US_BANK = ("account", "acct", "routing", "aba", "deposit", "bank")
SAYS_CA_BANK = ("transit", "institution", "bank", "account")
SAYS_PHONE = ("phone", "telephone", "tel", "mobile", "cell", "fax", "call")

#: The recognizers, best first among equal scores. Scores and patterns of national numbers are fixed values.
RECOGNIZERS: list[Recognizer] = [
    Recognizer("EMAIL_ADDRESS", (("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}", 1.0),)),
    Recognizer("CREDIT_CARD", (("(?<![0-9-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9-])", 1.0), ("(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])", 1.0)), luhn),
    Recognizer("IBAN_CODE", (("(?<![A-Z0-9])[A-Z]{2}[0-9]{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{0,4}(?![A-Z0-9])", 1.0),), iban_check),
    Recognizer("IP_ADDRESS", (("(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9.])", 0.95),), octets),
    Recognizer("URL", (("https?://[^\\s\"'<>]+", 0.9), ("(?<![\\w@.])www\\.[A-Za-z0-9-]+\\.[A-Za-z]{2,}[^\\s\"'<>]*", 0.85))),
    Recognizer("US_SSN", (("(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.9),), context=SAYS_SSN),
    Recognizer("CA_SIN", (("\\b[0-9]{3}-[0-9]{3}-[0-9]{3}\\b", 0.8), ("\\b[0-9]{9}\\b", 0.6)), context=SAYS_SIN),
    Recognizer("CA_TIN", (("\\b[0-9]{9}(RC|RM|RP|RT)[0-9]{4}\\b", 0.9), ("\\b[0-9]{5}-[0-9]{4}\\b", 0.6), ("\\b[0-9]{9}\\b", 0.5)), context=SAYS_TAX),
    Recognizer("US_BANK_ACCOUNT", (("\\b[0-9]{8,17}\\b", 0.5),), context=SAYS_US_BANK),
    Recognizer("CA_BANK_ACCOUNT", (("\\b[0-9]{5}-[0-9]{3}-[0-9]{7,12}\\b", 0.9),), context=SAYS_CA_BANK),
    Recognizer("PHONE_NUMBER", (("(?<![0-9+(-])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", 0.9),), context=SAYS_PHONE),
]


def register_recognizer(r: Recognizer) -> None:
    RECOGNIZERS.append(r)


#: Checks that a configured recognizer may name.
VALIDATORS = {"luhn": luhn, "octets": octets, "iban": iban_check}


def recognizers_of(config: dict) -> list[Recognizer]:
    """Recognizers as a YAML configuration lists them, by the entity that each supports.

    An entry without patterns, deny list or validator of its own takes those of
    the built-in recognizer of its entity; its context words come on top.
    """
    entries = (config.get("recognizer_registry") or {}).get("recognizers") or []
    own = {r.entity: r for r in RECOGNIZERS}
    out = []
    for e in entries:
        entity = e.get("supported_entity")
        if not entity:
            raise ValueError(f"recognizer {e.get('name')!r} names no supported_entity")
        patterns = tuple((java_pattern(p["regex"]), float(p["score"])) for p in e.get("patterns") or ())
        deny, validator, context = tuple(e.get("deny_list") or ()), e.get("validator"), tuple(e.get("context") or ())
        if validator is not None and validator not in VALIDATORS:
            raise ValueError(f"unknown validator {validator!r}")
        base = own.get(entity)
        if not patterns and not deny:
            if base is None:
                raise ValueError(f"recognizer {e.get('name')!r} has neither patterns nor a deny list, and {entity} is not built in")
            out.append(replace(base, context=(*base.context, *(w for w in context if w not in base.context))))
        else:
            out.append(Recognizer(entity, patterns, VALIDATORS.get(validator), context, deny))
    return out


def load_recognizers(path: str) -> list[Recognizer]:
    """The recognizers of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return recognizers_of(yaml.safe_load(f) or {})


def long_form(df: DataFrame, key: Column, allow: tuple[str, ...] = ()) -> DataFrame:
    """doc, path, pos, value of every string in the documents; allowed paths are left out.

    A document's leaves become one array and one ``explode``, so that a document
    is read once however many fields it has.
    """

    def entries(c: Column, kind: T.DataType, path: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [e for f in kind.fields for e in entries(c.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
        if any(matches(path, a) for a in allow):
            return []
        if isinstance(kind, T.StringType):
            return [F.array(F.struct(F.lit(path).alias("path"), F.lit(0).alias("pos"), c.alias("value")))]
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.StringType):
                return [F.transform(F.coalesce(c, F.array().cast(kind)), lambda e, i: F.struct(F.lit(path).alias("path"), i.alias("pos"), e.alias("value")))]
            if isinstance(inner, T.StructType):
                return [e for f in inner.fields for e in entries(F.transform(c, _field(f.name)), T.ArrayType(f.dataType), f"{path}.{f.name}")]
        return []

    parts = [e for f in df.schema.fields for e in entries(quoted(f.name), f.dataType, f.name)]
    if not parts:
        return df.select(key.alias("doc"), F.lit("").alias("path"), F.lit(0).alias("pos"), F.lit("").alias("value")).limit(0)
    return df.select(key.alias("doc"), F.explode(F.concat(*parts)).alias("e")).select("doc", "e.path", "e.pos", "e.value").where(F.col("value").rlike("\\S"))


def _field(name: str):
    return lambda e: e.getField(name)


def best_entity(values: DataFrame, entities: list[str] | None = None, threshold: float = 0.85, recognizers: list[Recognizer] | None = None) -> DataFrame:
    """``values`` (value, path) with entity and score of the best recognizer at the threshold or above."""
    table = [r for r in recognizers or RECOGNIZERS if entities is None or r.entity in entities]
    if not table:
        return values.limit(0).withColumn("entity", F.lit("")).withColumn("score", F.lit(0.0))
    path = F.col("path") if "path" in values.columns else None
    scored = F.array(*(F.struct(r.score(F.col("value"), path).alias("score"), F.lit(-i).alias("order"), F.lit(r.entity).alias("entity")) for i, r in enumerate(table)))
    enough = F.filter(F.array(F.array_max(scored)), lambda b: (b["score"] >= threshold) & (b["score"] > 0))
    # a generator is no expression that a filter could be pushed through: every recognizer runs once a value
    best = values.select("*", F.explode(enough).alias("b"))
    return best.select(*values.columns, F.col("b.entity").alias("entity"), F.col("b.score").alias("score"))


def field_statistics(found: DataFrame, total: int | Column, least_prevalence: float = 0.10) -> DataFrame:
    """path, entity: detections, prevalence, confidence and a first example, most prevalent first."""
    n = total if isinstance(total, Column) else F.lit(total)
    stats = found.groupBy("path", "entity").agg(
        F.count(F.lit(1)).alias("detections"), F.avg("score").alias("avg_confidence"), F.min("score").alias("min_confidence"), F.max("score").alias("max_confidence"), F.min_by("value", F.struct("doc", "pos")).alias("example")
    )
    return stats.withColumn("prevalence_pct", F.col("detections") / n * 100).where(F.col("prevalence_pct") >= least_prevalence * 100).orderBy(F.desc("prevalence_pct"), "path", "entity")


#: Kinds whose values are hashed when no strategy is configured; US_SSN only at 0.9 or more.
HASHED = ("CREDIT_CARD", "IBAN_CODE", "CRYPTO", "US_PASSPORT", "UK_PASSPORT")


def recommended(entity: Column, confidence: Column, strategies: dict[str, str] | None = None) -> Column:
    """The strategy of an entity: configured, the configured default, or hash or redact."""
    strategies = strategies or {}
    out = F.lit(None).cast("string")
    for name, value in strategies.items():
        if name != "DEFAULT":
            out = F.when(entity == name, F.lit(value)).otherwise(out)
    if "DEFAULT" in strategies:
        return F.coalesce(out, F.lit(strategies["DEFAULT"]))
    own = F.when(entity.isin(*HASHED) | ((entity == "US_SSN") & (confidence >= 0.9)), F.lit("hash")).otherwise(F.lit("redact"))
    return F.coalesce(out, own)


def summary(stats: DataFrame) -> DataFrame:
    """entity: fields and detections over all collections, most fields first."""
    return stats.groupBy("entity").agg(F.count(F.lit(1)).alias("fields"), F.sum("detections").alias("detections")).orderBy(F.desc("fields"), "entity")


def cursor_with_values(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that the rows have a value of; the candidate's spelling."""
    known = [c for c in candidates if cursor_field(df.schema, [c])]
    if not known:
        return None
    have = df.agg(*(F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(known))).first()
    return next((c for i, c in enumerate(known) if have[i]), None)


def cursor_field(schema: T.StructType, candidates: list[str]) -> str | None:
    """The first candidate that the schema has, whatever the case of its parts; the candidate's spelling."""
    for candidate in candidates:
        kind: T.DataType | None = schema
        for part in candidate.split("."):
            f = next((f for f in kind.fields if f.name.lower() == part.lower()), None) if isinstance(kind, T.StructType) else None
            kind = f.dataType if f else None
            if kind is None:
                break
        if kind is not None:
            return candidate
    return None
