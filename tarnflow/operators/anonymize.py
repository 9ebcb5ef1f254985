"""The registry of anonymization operators and how they apply to typed columns.

An operator is a function of a string column and keyword parameters. Values of
other types become text first, nulls stay null, arrays go element by element,
blank text stays as it is. Unknown operators and wrong parameters are errors
when the plan is made: no value passes unmasked because a name was misspelt.
"""

from __future__ import annotations

import inspect
import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.functions import fakes, masks


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(""))


def replace(c: Column, new_value: str = "") -> Column:
    return F.when(c.isNotNull(), F.lit(new_value))


def keep(c: Column) -> Column:
    return c


def hashed(c: Column, hash_type: str = "sha256", salt: str | None = None) -> Column:
    """Salted digest; without a salt each plan draws its own, so that plans do not join."""
    if hash_type not in ("sha256", "sha512"):
        raise ValueError("hash_type must be sha256 or sha512")
    salt = secrets.token_hex(16) if salt is None else salt
    return F.sha2(F.concat(F.lit(salt), c).cast("binary"), int(hash_type[3:]))


def encrypt(c: Column, key: str) -> Column:
    """AES-CBC with a random start, in base 64."""
    return F.base64(F.aes_encrypt(c.cast("binary"), F.lit(_key(key)), F.lit("CBC")))


def decrypt(c: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(_key(key)), F.lit("CBC")).cast("string")


def _key(key: str) -> bytes:
    raw = key.encode()
    if len(raw) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return raw


OPERATORS: dict[str, Callable[..., Column]] = {
    "mask_email": masks.mask_email,
    "mask_phone": masks.mask_phone,
    "mask_credit_card": masks.mask_credit_card,
    "mask_ssn": masks.mask_ssn,
    "mask_sin": masks.mask_sin,
    "mask_tin": masks.mask_tin,
    "mask_ip_address": masks.mask_ip_address,
    "mask_iban": masks.mask_iban,
    "mask_person": masks.mask_person,
    "mask_location": masks.mask_location,
    "mask_us_bank_account": masks.mask_bank_account,
    "mask_ca_bank_account": masks.mask_bank_account,
    "smart_mask": masks.smart_mask,
    "fake_email": fakes.fake_email,
    "fake_name": fakes.fake_name,
    "fake_phone": fakes.fake_phone,
    "fake_address": fakes.fake_address,
    "fake_ssn": fakes.fake_ssn,
    "fake_credit_card": fakes.fake_credit_card,
    "fake_iban": fakes.fake_iban,
    "fake_us_bank_account": fakes.fake_us_bank_account,
    "fake_ca_bank_account": fakes.fake_ca_bank_account,
    "fake_ip_address": fakes.fake_ip_address,
    "smart_fake": fakes.smart_fake,
    "redact": redact,
    "mask": masks.mask_range,
    "hash": hashed,
    "replace": replace,
    "keep": keep,
    "encrypt": encrypt,
    "decrypt": decrypt,
}
#: Other names of the same operators.
ALIASES = {
    "mask_us_bank": "mask_us_bank_account",
    "mask_ca_bank": "mask_ca_bank_account",
    "mask_ip": "mask_ip_address",
    "fake_ip": "fake_ip_address",
    "fake_location": "fake_address",
    "fake_us_bank": "fake_us_bank_account",
    "fake_ca_bank": "fake_ca_bank_account",
    "fake": "smart_fake",
}
MASK_NAMES = {k: next(n for n, f in OPERATORS.items() if f is masks.MASK_OF[k]) for k in masks.MASK_OF} | {"CA_BANK_ACCOUNT": "mask_ca_bank_account"}
FAKE_NAMES = {k: next(n for n, f in OPERATORS.items() if f is fakes.FAKE_OF[k]) for k in fakes.FAKE_OF}


def register(name: str, function: Callable[..., Column]) -> None:
    """Add an operator: a function of a string column and keyword parameters.

    The function may wrap a pandas UDF; it then runs in Arrow batches.
    """
    if not name or name in ALIASES:
        raise ValueError(f"{name!r} cannot be registered")
    OPERATORS[name] = function


def operator(name: str, params: dict | None = None, salt: str | None = None) -> Callable[[Column], Column]:
    """The operator of that name with its parameters bound; ValueError if either is unknown.

    Made-up values and digests that are given no salt use ``salt``, or draw one:
    without it nobody can find a value by trying all of them.
    """
    name = ALIASES.get(name, name)
    if name not in OPERATORS:
        raise ValueError(f"unknown anonymization operator {name!r}")
    f, params = OPERATORS[name], dict(params or {})
    accepted = inspect.signature(f).parameters
    if "entity_type" not in accepted:
        params.pop("entity_type", None)
    if unknown := [p for p in params if p not in accepted]:
        raise ValueError(f"{name} has no parameter {', '.join(unknown)}")
    needed = [p for p, d in list(accepted.items())[1:] if d.default is inspect.Parameter.empty and p not in params]
    if needed:
        raise ValueError(f"{name} needs {', '.join(needed)}")
    if "salt" in accepted and params.get("salt") is None:
        params["salt"] = salt if salt is not None else secrets.token_hex(16)
    return lambda c: f(c, **params)


def resolve_smart(name: str, entity_type: str | None) -> str:
    """The concrete operator of smart_mask or smart_fake for a kind of value; others stay."""
    if name not in ("smart_mask", "smart_fake"):
        return name
    return (MASK_NAMES if name == "smart_mask" else FAKE_NAMES).get(entity_type or "", "mask")


def as_text(c: Column, kind: T.DataType) -> Column:
    """The value as text; booleans are capitalized."""
    return F.initcap(c.cast("string")) if isinstance(kind, T.BooleanType) else c.cast("string")


def text_kind(kind: T.DataType) -> T.DataType:
    """The type with text in place of every value."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(text_kind(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, text_kind(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, text_kind(kind.valueType))
    return T.StringType()


def anonymized(c: Column, kind: T.DataType, apply: Callable[[Column], Column]) -> Column:
    """``apply`` on every value of a column of any type: elements, fields of documents, values of maps."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: anonymized(e, kind.elementType, apply))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(anonymized(c.getField(f.name), f.dataType, apply).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: anonymized(v, kind.valueType, apply))
    text = as_text(c, kind)
    return F.when(text.rlike("^\\s*$"), text).when(text.isNotNull(), apply(text))


def sequence(steps: list[tuple[str, dict | None]]) -> Callable[[Column], Column]:
    """Several operators in turn; blank results of one are left alone by the next."""
    bound = [operator(n, p) for n, p in steps]
    return lambda c: reduce(lambda x, f: F.when(x.rlike("^\\s*$"), x).otherwise(f(x)), bound, c)


def anonymize_text(spark, text: str | None, name: str, entity_type: str | None = None) -> str | None:
    """One value through an operator, for reports."""
    if text is None or not text.strip():
        return text
    f = operator(resolve_smart(name, entity_type), {"entity_type": entity_type} if entity_type else None)
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def supported_entities() -> list[str]:
    """The kinds of values for which a mask or a made-up value exists."""
    return sorted({*MASK_NAMES, *FAKE_NAMES})


def operators_for(entity_type: str) -> list[str]:
    """The operators that fit a kind of value: its own first, then those for any."""
    own = [table[entity_type] for table in (MASK_NAMES, FAKE_NAMES) if entity_type in table]
    return [*own, "smart_mask", "smart_fake", "redact", "mask", "hash", "replace", "keep", "encrypt"]
