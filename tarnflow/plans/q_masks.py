"""Queries of the anonymization operators, through the transform pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions import fakes
from tarnflow.functions.masks import detect_format
from tarnflow.operators.anonymize import resolve_smart
from tarnflow.operators.transforms import Pipeline
from tarnflow.plans.samples import people, people_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def masked(name: str, column: str, operator: str, expr: str, params: dict | None = None) -> None:
    """Register ``operator`` on ``column``; ``expr`` is the SQL over ``v`` for values that are not blank."""

    if "fake" in operator:  # without a salt each plan would draw its own
        params = {**(params or {}), "salt": ""}

    def query(spark, sf_dir):
        step = {"type": "anonymize", "field": column, "operator": operator, "params": params}
        return Pipeline([step]).apply(people(spark, sf_dir, column)).df.withColumnRenamed(column, "masked")

    QUERIES[name] = query
    ORACLES[name] = f"SELECT c_custkey, CASE WHEN v IS NULL THEN NULL WHEN regexp_full_match(v, '\\s*') THEN v ELSE {expr} END AS masked FROM (SELECT c_custkey, {column} AS v FROM {people_sql(column)})"


def last_digits(keep: int, empty: str, v: str = "v") -> str:
    count = lambda x: f"length(regexp_replace({x}, '[^0-9]', '', 'g'))"
    each = f"list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN regexp_full_match(substr({v}, i, 1), '[0-9]') AND {count(f'substr({v}, i)')} > {keep} THEN '*' ELSE substr({v}, i, 1) END)"
    return f"CASE WHEN {v} = '' THEN '{empty}' WHEN {count(v)} < {keep} THEN repeat('*', length({v})) ELSE array_to_string({each}, '') END"


def email(v: str = "v") -> str:
    local, domain = f"regexp_extract({v}, '^(.*)@([^@]*)$', 1)", f"regexp_extract({v}, '^(.*)@([^@]*)$', 2)"
    hidden = f"CASE WHEN length({local}) <= 5 THEN repeat('*', length({local})) ELSE left({local}, 2) || repeat('*', length({local}) - 4) || right({local}, 2) END"
    return f"CASE WHEN contains({v}, '@') THEN ({hidden}) || '@' || (CASE WHEN length({domain}) <= 5 THEN repeat('*', length({domain})) ELSE {domain} END) ELSE '***@***.com' END"


def words(each: str, v: str = "v") -> str:
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> ''), lambda w: {each}), ' ')"


RUNS = "array_to_string(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN regexp_full_match(substr(v, i, 1), '[0-9]') AND regexp_full_match(substr(v, i + 1, 4), '[0-9]{4}') THEN '*' ELSE substr(v, i, 1) END), '')"
IP = "CASE WHEN len(string_split(v, '.')) = 4 THEN split_part(v, '.', 1) || '.***.*.' || split_part(v, '.', 4) ELSE '***.***.***.***' END"
IBAN = "CASE WHEN length(v) < 6 THEN repeat('*', 20) ELSE left(v, 2) || repeat('*', length(v) - 6) || right(v, 4) END"
PERSON = words("left(w, 1) || repeat('*', greatest(1, length(w) - 1))")
PLACE = words("left(w, 3) || repeat('*', greatest(0, length(w) - 3))")
GENERIC = "CASE WHEN length(v) <= 6 THEN repeat('*', length(v)) ELSE left(v, 3) || repeat('*', length(v) - 6) || right(v, 3) END"
COUNT = "length(regexp_replace(trim(v), '[^0-9]', '', 'g'))"
KIND = (
    "CASE WHEN regexp_matches(trim(v), '@[^@]*\\.[^@]*$') THEN 'EMAIL_ADDRESS' WHEN regexp_full_match(trim(v), '[0-9]{1,3}(\\.[0-9]{1,3}){3}') THEN 'IP_ADDRESS' "
    f"WHEN regexp_full_match(trim(v), '[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}') THEN 'US_SSN' WHEN {COUNT} = 16 THEN 'CREDIT_CARD' "
    f"WHEN {COUNT} >= 7 AND (regexp_matches(trim(v), '[-()+ ]') OR {COUNT} >= 10) THEN 'PHONE_NUMBER' WHEN length(trim(v)) > 15 AND regexp_full_match(trim(v), '[A-Za-z]{{2}}[A-Za-z0-9]+') THEN 'IBAN_CODE' ELSE 'GENERIC' END"
)

masked("mask_email", "email", "mask_email", email())
masked("mask_email_without_domain", "email", "mask_email", "CASE WHEN contains(v, '@') THEN regexp_replace(" + email() + ", '@.*$', '') || '@' || repeat('*', length(regexp_extract(v, '@([^@]*)$', 1))) ELSE '***@***.com' END", {"keep_domain": False})
masked("mask_phone", "phone", "mask_phone", last_digits(4, "***-****"))
masked("mask_credit_card", "card", "mask_credit_card", last_digits(4, "*" * 12))
masked("mask_ssn", "ssn", "mask_ssn", last_digits(4, "***-**-****"))
masked("mask_sin", "sin", "mask_sin", last_digits(3, "***-***-***"))
masked("mask_tin", "tin", "mask_tin", last_digits(4, "*" * 9))
masked("mask_ip", "ip", "mask_ip_address", IP)
masked("mask_iban", "iban", "mask_iban", IBAN)
masked("mask_person", "person", "mask_person", PERSON)
masked("mask_location", "place", "mask_location", PLACE)
masked("mask_us_bank", "us_bank", "mask_us_bank_account", RUNS)
masked("mask_ca_bank", "ca_bank", "mask_ca_bank_account", RUNS)
masked("smart_mask_entity", "place", "smart_mask", PLACE, {"entity_type": "LOCATION"})
masked("smart_mask_generic", "secret", "smart_mask", GENERIC)
masked("redact", "secret", "redact", "''")
masked("mask_builtin", "secret", "mask", "left(v, length(v) - 3) || '###'", {"masking_char": "#", "chars_to_mask": 3, "from_end": True})
masked("hash_salted", "secret", "hash", "sha256('pepper' || v)", {"salt": "pepper"})
masked("replace", "secret", "replace", "'<gone>'", {"new_value": "<gone>"})
masked("keep", "secret", "keep", "v")

MIXED = {"email": email(), "card": last_digits(4, ""), "ssn": last_digits(4, ""), "ip": IP, "phone": last_digits(4, ""), "iban": IBAN, "secret": GENERIC}
BY_KIND = {"EMAIL_ADDRESS": email(), "IP_ADDRESS": IP, "US_SSN": last_digits(4, ""), "CREDIT_CARD": last_digits(4, ""), "PHONE_NUMBER": last_digits(4, ""), "IBAN_CODE": IBAN}


def _mixed(spark, sf_dir):
    """One column that holds values of every kind."""
    df = people(spark, sf_dir, *MIXED)
    pick = F.element_at(F.array(*MIXED), (F.col("c_custkey") % len(MIXED) + 1).cast("int"))
    return df.select("c_custkey", pick.alias("v"))


def _mixed_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(MIXED))
    return f"(SELECT c_custkey, CASE c_custkey % {len(MIXED)} {cases} END AS v FROM {people_sql(*MIXED)})"


QUERIES["detect_format"] = lambda spark, d: _mixed(spark, d).where("v is not null").select("c_custkey", detect_format(F.col("v")).alias("kind"))
ORACLES["detect_format"] = f"SELECT c_custkey, {KIND} AS kind FROM {_mixed_sql()} WHERE v IS NOT NULL"
QUERIES["smart_mask"] = lambda spark, d: Pipeline([{"type": "anonymize", "field": "v", "operator": "smart_mask"}]).apply(_mixed(spark, d)).df.withColumnRenamed("v", "masked")
ORACLES["smart_mask"] = f"SELECT c_custkey, CASE WHEN v IS NULL THEN NULL WHEN regexp_full_match(v, '\\s*') THEN v ELSE CASE {KIND} {' '.join(f'WHEN {k!r} THEN {e}' for k, e in BY_KIND.items())} ELSE {GENERIC} END END AS masked FROM {_mixed_sql()}"

# -- made-up values


def number(tag: str, v: str = "v") -> str:
    return f"(('0x' || substr(md5('{tag}::' || {v}), 1, 8))::BIGINT)"


def pick(options: list[str], tag: str) -> str:
    return f"list_extract([{', '.join(repr(o) for o in options)}], {number(tag)} % {len(options)} + 1)"


def some_digits(n: int, tag: str) -> str:
    sizes = [8] * (n // 8) + [n % 8] * bool(n % 8)
    return "(" + " || ".join(f"lpad(({number(f'{tag}{i}')} % {10**k})::VARCHAR, {k}, '0')" for i, k in enumerate(sizes)) + ")"


NAME = f"({pick(fakes.FIRST, 'first')} || ' ' || {pick(fakes.LAST, 'last')})"
MAIL = f"(lower({pick(fakes.FIRST, 'first')}) || '.' || lower({pick(fakes.LAST, 'last')}) || {some_digits(4, 'mail')} || '@' || {pick(fakes.HOSTS, 'host')})"
PHONE = f"('+1-' || ({number('area')} % 800 + 200)::VARCHAR || '-555-' || {some_digits(4, 'line')})"
ADDRESS = f"(({number('house')} % 9899 + 100)::VARCHAR || ' ' || {pick(fakes.STREETS, 'street')} || ' ' || {pick(fakes.KINDS, 'kind')})"
SSN = f"({some_digits(3, 'ssn-a')} || '-' || {some_digits(2, 'ssn-b')} || '-' || {some_digits(4, 'ssn-c')})"
BODY = f"('4' || {some_digits(14, 'card')})"
SUM = f"list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (substr({BODY}, i, 1)::INT * 2) % 10 + (substr({BODY}, i, 1)::INT * 2) // 10 ELSE substr({BODY}, i, 1)::INT END))"
CARD = f"({BODY} || ((10 - {SUM} % 10) % 10)::BIGINT::VARCHAR)"
FAKE_IBAN = f"((CASE WHEN length(v) >= 2 THEN left(v, 2) ELSE {pick(fakes.COUNTRIES, 'country')} END) || {some_digits(20, 'iban')})"
FAKE_IP = f"(({number('ip0')} % 223 + 1)::VARCHAR || '.' || ({number('ip1')} % 256)::VARCHAR || '.' || ({number('ip2')} % 256)::VARCHAR || '.' || ({number('ip3')} % 256)::VARCHAR)"
US = f"('Routing: ' || {some_digits(9, 'routing')} || ', Account: ' || {some_digits(10, 'account')})"
CA = f"({some_digits(5, 'transit')} || '-' || {some_digits(3, 'bank')} || '-' || {some_digits(10, 'account')})"

masked("fake_email", "email", "fake_email", MAIL)
masked("fake_name", "person", "fake_name", NAME)
masked("fake_phone", "phone", "fake_phone", PHONE)
masked("fake_address", "place", "fake_address", ADDRESS)
masked("fake_ssn", "ssn", "fake_ssn", SSN)
masked("fake_credit_card", "card", "fake_credit_card", CARD)
masked("fake_iban", "iban", "fake_iban", FAKE_IBAN)
masked("fake_us_bank", "us_bank", "fake_us_bank_account", US)
masked("fake_ca_bank", "ca_bank", "fake_ca_bank_account", CA)
masked("fake_ip", "ip", "fake_ip_address", FAKE_IP)
masked("smart_fake_entity", "person", "smart_fake", NAME, {"entity_type": "PERSON"})
masked("smart_fake_number", "secret", "smart_fake", some_digits(10, "id"))


def encrypt_round_trip(spark, sf_dir):
    """Encrypted values decrypt to themselves, and are not themselves."""
    key = {"key": "0123456789abcdef"}
    df = people(spark, sf_dir, "secret").withColumn("plain", F.col("secret"))
    hidden = Pipeline([{"type": "anonymize", "field": "secret", "operator": "encrypt", "params": key}]).apply(df).df.withColumn("hidden", F.col("secret"))
    back = Pipeline([{"type": "anonymize", "field": "secret", "operator": "decrypt", "params": key}]).apply(hidden).df
    return back.select("c_custkey", (F.col("secret") == F.col("plain")).alias("same"), (F.col("hidden") != F.col("plain")).alias("changed"))


QUERIES["encrypt_round_trip"] = encrypt_round_trip
ORACLES["encrypt_round_trip"] = "SELECT c_custkey, true AS same, true AS changed FROM customer"


def multi_entity(spark, sf_dir):
    """Two operators on one field, in order."""
    steps = [{"type": "anonymize", "field": "ssn", "operator": o, "params": p} for o, p in (("mask_ssn", None), ("hash", {"salt": "s"}))]
    return Pipeline(steps).apply(people(spark, sf_dir, "ssn")).df.withColumnRenamed("ssn", "masked")


QUERIES["multi_entity"] = multi_entity
ORACLES["multi_entity"] = f"SELECT c_custkey, sha256('s' || ({last_digits(4, '')})) AS masked FROM (SELECT c_custkey, ssn AS v FROM {people_sql('ssn')})"


def resolve_smart_operators(spark, sf_dir):
    pairs = [(o, e) for o in ("smart_mask", "smart_fake", "hash") for e in ("EMAIL_ADDRESS", "PERSON", "CA_SIN", "NOTHING")]
    return spark.createDataFrame([(o, e, resolve_smart(o, e)) for o, e in pairs], "operator string, entity string, resolved string")


QUERIES["resolve_smart"] = resolve_smart_operators
ORACLES["resolve_smart"] = (
    "SELECT * FROM (VALUES ('smart_mask', 'EMAIL_ADDRESS', 'mask_email'), ('smart_mask', 'PERSON', 'mask_person'), ('smart_mask', 'CA_SIN', 'mask_sin'), ('smart_mask', 'NOTHING', 'mask'), "
    "('smart_fake', 'EMAIL_ADDRESS', 'fake_email'), ('smart_fake', 'PERSON', 'fake_name'), ('smart_fake', 'CA_SIN', 'mask'), ('smart_fake', 'NOTHING', 'mask'), "
    "('hash', 'EMAIL_ADDRESS', 'hash'), ('hash', 'PERSON', 'hash'), ('hash', 'CA_SIN', 'hash'), ('hash', 'NOTHING', 'hash')) t(operator, entity, resolved)"
)
#: The projection of twenty masks at once, the nearest thing to the stated workload of batched anonymization.
TWENTY = [("mask_email", "email"), ("mask_phone", "phone"), ("mask_credit_card", "card"), ("mask_ssn", "ssn"), ("mask_sin", "sin"), ("mask_tin", "tin"), ("mask_ip_address", "ip"), ("mask_iban", "iban"), ("mask_person", "person"), ("mask_location", "place")]


def twenty_masks(spark, sf_dir):
    return twenty_of(people(spark, sf_dir, *(c for _, c in TWENTY)))


def twenty_of(df):
    """Twenty masks in one projection over rows of ``people``."""
    names = [c for _, c in TWENTY]
    df = df.select("c_custkey", *names, *(F.col(c).alias(f"{c}_2") for c in names))
    steps = [{"type": "anonymize", "field": f"{c}{s}", "operator": o} for s in ("", "_2") for o, c in TWENTY]
    out = Pipeline(steps).apply(df).df
    return out.select("c_custkey", F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in out.columns if c != "c_custkey")).cast("binary"), 256).alias("digest"))


def _twenty_sql() -> str:
    exprs = {"email": email("email"), "phone": last_digits(4, "", "phone"), "card": last_digits(4, "", "card"), "ssn": last_digits(4, "", "ssn"), "sin": last_digits(3, "", "sin"), "tin": last_digits(4, "", "tin")}
    exprs |= {c: f"(SELECT {e} FROM (SELECT {c} AS v))" for c, e in (("ip", IP), ("iban", IBAN), ("person", PERSON), ("place", PLACE))}
    one = [f"coalesce(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_full_match({c}, '\\s*') THEN {c} ELSE {exprs[c]} END, '-')" for _, c in TWENTY]
    return f"SELECT c_custkey, sha256(concat_ws('|', {', '.join(one + one)})) AS digest FROM {people_sql(*(c for _, c in TWENTY))}"


QUERIES["twenty_masks"] = twenty_masks
ORACLES["twenty_masks"] = _twenty_sql()
