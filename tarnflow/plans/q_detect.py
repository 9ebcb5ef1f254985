"""Queries of the detection of personal values and its statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators.detect import best_entity, field_statistics, long_form, recommended, summary
from tarnflow.plans.samples import people, people_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("text").alias("path"), F.lit(0).alias("pos"), F.col("text").alias("value"))


def detect(name: str, entity: str, sql: str, score: str) -> None:
    """Documents in which an entity occurs, with the score."""
    QUERIES[name] = lambda spark, d: best_entity(texts(spark, d), [entity], 0.5).select("doc", "entity", "score")
    ORACLES[name] = f"SELECT doc_id AS doc, '{entity}' AS entity, CAST({score} AS DOUBLE) AS score FROM documents WHERE {sql}"


EMAIL = "regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}')"
IP = "list_aggregate(list_transform(string_split(regexp_extract(text, '(^|[^0-9.])([0-9]{1,3}(\\.[0-9]{1,3}){3})($|[^0-9.])', 2), '.'), lambda p: TRY_CAST(p AS INT) <= 255), 'bool_and')"
URL1, URL2 = "regexp_matches(text, 'https?://[^\\s\"''<>]+')", "regexp_matches(text, '(^|[^\\w@.])www\\.[A-Za-z0-9-]+\\.[A-Za-z]{2,}')"
detect("detect_email", "EMAIL_ADDRESS", EMAIL, "1.0")
detect("detect_ip", "IP_ADDRESS", f"regexp_matches(text, '(^|[^0-9.])([0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}})($|[^0-9.])') AND {IP}", "0.95")
QUERIES["detect_url"] = lambda spark, d: best_entity(table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.lit("f").alias("path"), F.lit(0).alias("pos"), F.col("html").alias("value")).unionByName(texts(spark, d)), ["URL"], 0.5).select("doc", "path", "score")
ORACLES["detect_url"] = f"SELECT id AS doc, path, CASE WHEN {URL1} THEN 0.9 ELSE 0.85 END::DOUBLE AS score FROM (SELECT page_id AS id, 'f' AS path, html AS text FROM pages UNION ALL SELECT doc_id, 'text', text FROM documents) WHERE {URL1} OR {URL2}"


def luhn(digits: str) -> str:
    """Whether a string of digits passes, the rightmost being the check digit."""
    place = f"substr({digits}, length({digits}) + 1 - i, 1)::INT"
    return f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN ({place} * 2) % 10 + ({place} * 2) // 10 ELSE {place} END)) % 10 = 0)"


_CARD = "regexp_replace(regexp_extract(text, '(^|[^0-9-])(([0-9]{4}[ -]?){3}[0-9]{4})($|[^0-9-])', 2), '[^0-9]', '', 'g')"
_AMEX = "regexp_replace(regexp_extract(text, '(^|[^0-9-])(3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})($|[^0-9-])', 2), '[^0-9]', '', 'g')"
QUERIES["detect_card_luhn"] = lambda spark, d: best_entity(texts(spark, d), ["CREDIT_CARD"], 0.5).select("doc", "entity", "score")
ORACLES["detect_card_luhn"] = f"SELECT doc_id AS doc, 'CREDIT_CARD' AS entity, 1.0::DOUBLE AS score FROM (SELECT doc_id, {_CARD} AS a, {_AMEX} AS b FROM documents) WHERE (a <> '' AND {luhn('a')}) OR (b <> '' AND {luhn('b')})"

# Values from the derived columns, where their kinds are known
BAD_SSN = "(left(ssn, 3) IN ('000', '666') OR left(ssn, 1) = '9' OR substr(ssn, 5, 2) = '00' OR right(ssn, 4) = '0000')"


def column(spark, sf_dir, name):
    return people(spark, sf_dir, name).select(F.col("c_custkey").alias("doc"), F.lit("field").alias("path"), F.lit(0).alias("pos"), F.col(name).alias("value")).where("value is not null")


QUERIES["detect_ssn"] = lambda spark, d: best_entity(column(spark, d, "ssn"), ["US_SSN"], 0.85).select("doc", "score")
ORACLES["detect_ssn"] = f"SELECT c_custkey AS doc, 0.9::DOUBLE AS score FROM {people_sql('ssn')} WHERE NOT {BAD_SSN}"
QUERIES["detect_phone"] = lambda spark, d: best_entity(column(spark, d, "phone"), ["PHONE_NUMBER"], 0.85).select("doc", "score")
ORACLES["detect_phone"] = f"SELECT c_custkey AS doc, 0.9::DOUBLE AS score FROM {people_sql('phone')} WHERE phone <> '123'"
QUERIES["detect_sin"] = lambda spark, d: best_entity(column(spark, d, "sin"), ["CA_SIN"], 0.5).select("doc", "score")
ORACLES["detect_sin"] = f"SELECT c_custkey AS doc, CASE WHEN contains(sin, '-') THEN 0.8 ELSE 0.6 END::DOUBLE AS score FROM {people_sql('sin')}"
QUERIES["detect_tin"] = lambda spark, d: best_entity(column(spark, d, "tin"), ["CA_TIN"], 0.5).select("doc", "score")
ORACLES["detect_tin"] = f"SELECT c_custkey AS doc, 0.9::DOUBLE AS score FROM {people_sql('tin')} WHERE tin <> '123'"


def ibans(spark, sf_dir):
    """Every other value has a wrong digit."""
    value = F.when(F.col("c_custkey") % 2 == 0, F.lit("GB82 WEST 1234 5698 7654 32")).otherwise(F.lit("GB82WEST12345698765433"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit("f").alias("path"), F.lit(0).alias("pos"), value.alias("value"))


QUERIES["detect_iban"] = lambda spark, d: best_entity(ibans(spark, d), ["IBAN_CODE"], 0.85).select("doc", "entity")
ORACLES["detect_iban"] = "SELECT c_custkey AS doc, 'IBAN_CODE' AS entity FROM customer WHERE c_custkey % 2 = 0"

FIELDS = ("email", "phone", "ip")
KINDS = ["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"]
#: Values that are found, by field; the path ``phone`` is a context word and raises its score.
FOUND = f"(SELECT 'email' AS path, 'EMAIL_ADDRESS' AS entity, 1.0 AS score, c_custkey AS doc, email AS value FROM {people_sql('email')} WHERE contains(email, '@') UNION ALL SELECT 'phone', 'PHONE_NUMBER', 1.0, c_custkey, phone FROM {people_sql('phone')} WHERE phone <> '123' UNION ALL SELECT 'ip', 'IP_ADDRESS', 0.95, c_custkey, ip FROM {people_sql('ip')} WHERE ip <> 'not.an.ip')"


def found(spark, sf_dir):
    return best_entity(long_form(people(spark, sf_dir, *FIELDS), F.col("c_custkey")), KINDS, 0.85)


def profile(spark, sf_dir):
    total = table(spark, sf_dir, "customer").count()
    return field_statistics(found(spark, sf_dir), total)


QUERIES["best_entity"] = lambda spark, d: found(spark, d).select("doc", "path", "entity", "score")
ORACLES["best_entity"] = f"SELECT doc, path, entity, score::DOUBLE AS score FROM {FOUND}"
QUERIES["pii_profile"] = profile
ORACLES["pii_profile"] = f"SELECT path, entity, count(*) AS detections, avg(score)::DOUBLE AS avg_confidence, min(score)::DOUBLE AS min_confidence, max(score)::DOUBLE AS max_confidence, arg_min(value, doc) AS example, count(*) / (SELECT count(*) FROM customer) * 100 AS prevalence_pct FROM {FOUND} GROUP BY path, entity"
QUERIES["prevalence_filter"] = lambda spark, d: field_statistics(found(spark, d), table(spark, d, "customer").count(), 0.85).select("path", "detections")
ORACLES["prevalence_filter"] = f"SELECT path, count(*) AS detections FROM {FOUND} GROUP BY path HAVING count(*) >= 0.85 * (SELECT count(*) FROM customer)"
QUERIES["pii_summary"] = lambda spark, d: summary(profile(spark, d))
ORACLES["pii_summary"] = f"SELECT entity, count(DISTINCT path) AS fields, count(*) AS detections FROM {FOUND} GROUP BY entity"
QUERIES["pii_allowlist"] = lambda spark, d: best_entity(long_form(people(spark, d, *FIELDS), F.col("c_custkey"), ("*mail", "ip")), KINDS, 0.85).select("doc", "path")
ORACLES["pii_allowlist"] = f"SELECT doc, path FROM {FOUND} WHERE path = 'phone'"


def recommend_strategy(spark, sf_dir):
    rows = [("CREDIT_CARD", 0.9), ("US_SSN", 0.95), ("US_SSN", 0.85), ("EMAIL_ADDRESS", 1.0), ("PERSON", 0.9)]
    df = spark.createDataFrame(rows, "entity string, confidence double")
    entity, confidence = F.col("entity"), F.col("confidence")
    return df.select("entity", "confidence", recommended(entity, confidence).alias("own"), recommended(entity, confidence, {"EMAIL_ADDRESS": "smart_mask", "DEFAULT": "keep"}).alias("configured"))


QUERIES["recommend_strategy"] = recommend_strategy
ORACLES["recommend_strategy"] = "SELECT entity, confidence::DOUBLE AS confidence, own, configured FROM (VALUES ('CREDIT_CARD', 0.9, 'hash', 'keep'), ('US_SSN', 0.95, 'hash', 'keep'), ('US_SSN', 0.85, 'redact', 'keep'), ('EMAIL_ADDRESS', 1.0, 'redact', 'smart_mask'), ('PERSON', 0.9, 'redact', 'keep')) t(entity, confidence, own, configured)"


def flatten(spark, sf_dir):
    """The long form of nested documents: arrays of values and of documents."""
    k = F.col("c_custkey")
    df = people(spark, sf_dir, "email").select("c_custkey", F.struct(F.col("email").alias("mail")).alias("user"), F.array(F.lit("x"), k.cast("string")).alias("tags"), F.array(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("phone"))).alias("contacts"))
    return long_form(df, k)


QUERIES["flatten_documents"] = flatten
ORACLES["flatten_documents"] = f"SELECT c_custkey AS doc, 'user.mail' AS path, 0 AS pos, email AS value FROM {people_sql('email')} WHERE email IS NOT NULL AND email <> ' ' UNION ALL SELECT c_custkey, 'tags', 0, 'x' FROM customer UNION ALL SELECT c_custkey, 'tags', 1, c_custkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'contacts.phone', 0, 'p' || c_custkey FROM customer"
