"""Queries of the field steps, conditions, error modes and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators.transforms import Pipeline
from tarnflow.plans.samples import people, people_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COLS = ("nick", "score", "person")


def steps(name: str, sql: str, *todo: dict, mode: str = "skip", out: list[str] | None = None) -> None:
    """Register a pipeline over c_custkey, nick, score, person; ``sql`` selects from ``t``."""

    def query(spark, sf_dir):
        df = Pipeline(list(todo), mode).apply(people(spark, sf_dir, *COLS)).df
        return df.select(*out) if out else df

    QUERIES[name] = query
    ORACLES[name] = f"SELECT {sql} FROM {people_sql(*COLS)} t"


ALL = "c_custkey, nick, score, person"
steps("add_field", f"{ALL}, 'new' AS tag", {"type": "add_field", "field": "tag", "value": "new"})
steps("add_field_conflict", "c_custkey, coalesce(nick, 'none') AS nick, score, person", {"type": "add_field", "field": "nick", "value": "none"})
steps("set_field", "c_custkey, 'x' AS nick, score, person", {"type": "set_field", "field": "nick", "value": "x"})
steps("set_nested", f"{ALL}, 'a' AS a, person AS b", {"type": "set_field", "field": "meta.a", "value": "a"}, {"type": "set_field", "field": "meta.in.b", "value": "${person}"}, out=["c_custkey", "nick", "score", "person", "meta.a", "meta.in.b"])
steps("remove_field", "c_custkey, person", {"type": "remove_field", "field": ["nick", "score", "absent"]})
steps("remove_nested", f"{ALL}, 1 AS a", {"type": "set_field", "field": "m.a", "value": 1}, {"type": "set_field", "field": "m.x.y", "value": 2}, {"type": "remove_field", "field": "m.x.y"}, out=["c_custkey", "nick", "score", "person", "m.a"])
steps("rename_field", "c_custkey, nick AS alias, score, person", {"type": "rename_field", "from_field": "nick", "to_field": "alias"})
steps("rename_conflict", "c_custkey, CASE WHEN nick IS NOT NULL THEN nick END AS nick, score, CASE WHEN nick IS NULL THEN person ELSE person END AS person", {"type": "rename_field", "from_field": "nick", "to_field": "person"})
steps("rename_overwrite", "c_custkey, score, coalesce(nick, person) AS person", {"type": "rename_field", "from_field": "nick", "to_field": "person", "overwrite": True}, out=["c_custkey", "score", "person"])
steps("copy_field", f"{ALL}, score AS points", {"type": "copy_field", "from_field": "score", "to_field": "points"})
steps("copy_overwrite", "c_custkey, nick, score, coalesce(nick, person) AS person", {"type": "copy_field", "from_field": "nick", "to_field": "person", "overwrite": True})
steps("regex_replace", "c_custkey, nick, score, regexp_replace(person, '^(\\w+) (\\w+)$', '\\2, \\1') AS person", {"type": "regex_replace", "field": "person", "pattern": r"^(\w+) (\w+)$", "replacement": r"\2, \1"})
steps("regex_replace_all", "c_custkey, nick, score, regexp_replace(person, '[aeiou]', '$', 'g') AS person", {"type": "regex_replace", "field": "person", "pattern": "[aeiou]", "replacement": "$"})
steps("template_concat", f"{ALL}, concat('<', coalesce(nick, ''), '/', coalesce(CAST(score AS VARCHAR), ''), '>') AS label", {"type": "add_field", "field": "label", "value": "<${nick}/${score}>"})
steps("template_typed", f"{ALL}, score AS points, CAST(NULL AS VARCHAR) AS nothing, '$5' AS price", {"type": "add_field", "field": "points", "value": "${score}"}, {"type": "add_field", "field": "nothing", "value": "${null}"}, {"type": "add_field", "field": "price", "value": "$5"})
steps("template_nested", f"{ALL}, nick AS who, 'k' AS kind", {"type": "add_field", "field": "audit", "value": {"who": "${nick}", "kind": "k"}}, out=["c_custkey", "nick", "score", "person", "audit.who", "audit.kind"])

CONDITIONS = {
    "exists": ("$exists", True, "score IS NOT NULL"),
    "not_exists": ("$exists", False, "score IS NULL"),
    "eq": ("$eq", 10, "score IS NOT DISTINCT FROM 10"),
    "ne": ("$ne", 10, "score IS DISTINCT FROM 10"),
    "gt": ("$gt", 50, "coalesce(score > 50, false)"),
    "gte": ("$gte", 50, "coalesce(score >= 50, false)"),
    "lt": ("$lt", 50, "coalesce(score < 50, false)"),
    "lte": ("$lte", 50, "coalesce(score <= 50, false)"),
    "in": ("$in", [1, 2, None], "(score IN (1, 2)) IS TRUE OR score IS NULL"),
    "nin": ("$nin", [1, 2], "(score IN (1, 2)) IS NOT TRUE"),
}
for _name, (_op, _value, _sql) in CONDITIONS.items():
    steps(f"cond_{_name}", f"c_custkey, CASE WHEN {_sql} THEN 'hit' ELSE nick END AS nick, score, person", {"type": "set_field", "field": "nick", "value": "hit", "condition": {"field": "score", "operator": _op, "value": _value}})
steps("cond_regex", "c_custkey, nick, score, CASE WHEN regexp_matches(nick, '(?i)^N[1-3]$') IS TRUE THEN 'hit' ELSE person END AS person", {"type": "set_field", "field": "person", "value": "hit", "condition": {"field": "nick", "operator": "$regex", "value": "(?i)^N[1-3]$"}})
steps("cond_remove", "c_custkey, CASE WHEN score > 50 THEN NULL ELSE nick END AS nick, score, person", {"type": "remove_field", "field": "nick", "condition": {"field": "score", "operator": "$gt", "value": 50}})
steps("cond_anonymize", "c_custkey, CASE WHEN score > 50 THEN CASE WHEN nick IS NULL THEN NULL ELSE '' END ELSE nick END AS nick, score, person", {"type": "anonymize", "field": "nick", "operator": "redact", "condition": {"field": "score", "operator": "$gt", "value": 50}})
steps(
    "skip_keeps_original",
    "c_custkey, nick, CASE WHEN nick IS NULL THEN 7 ELSE score END AS score, person",
    {"type": "set_field", "field": "score", "value": 7},
    {"type": "add_field", "field": "nick", "value": None},
)
steps("anonymize_after_fields", "c_custkey, nick, score, 'Z*** Y*' AS person", {"type": "anonymize", "field": "person", "operator": "mask_person"}, {"type": "set_field", "field": "person", "value": "Zorg Yo"})

STATS = [
    {"type": "add_field", "field": "nick", "value": "none"},
    {"type": "set_field", "field": "tag", "value": "t", "condition": {"field": "score", "operator": "$gt", "value": 50}},
    {"type": "rename_field", "from_field": "score", "to_field": "points"},
    {"type": "anonymize", "field": "person", "operator": "redact"},
]


def transform_stats(spark, sf_dir):
    """The counts of one pass, as rows."""
    result = Pipeline(STATS).apply(people(spark, sf_dir, *COLS))
    result.df.write.format("noop").mode("overwrite").save()
    s = result.statistics()
    rows = [("processed", s["documents_processed"]), ("failed", s["documents_failed"]), ("skipped", s["transforms_skipped"]), *((k, v["fields_processed"]) for k, v in s["operations"].items())]
    return spark.createDataFrame(rows, "what string, n bigint")


QUERIES["transform_stats"] = transform_stats
ORACLES["transform_stats"] = (
    "SELECT what, n::BIGINT AS n FROM (SELECT count(*) FILTER (nick IS NULL) AS processed, count(nick) AS failed, count(*) FILTER (nick IS NULL AND (score > 50) IS NOT TRUE) AS skipped, count(*) FILTER (nick IS NULL) AS add_field, "
    "count(*) FILTER (nick IS NULL AND score > 50) AS set_field, count(*) FILTER (nick IS NULL AND score IS NOT NULL) AS rename_field, count(*) AS anonymize FROM " + people_sql(*COLS) + ") UNPIVOT (n FOR what IN (processed, failed, skipped, add_field, set_field, rename_field, anonymize))"
)


def lines(spark, sf_dir):
    """Orders with their lines as an array of documents."""
    item = F.struct(F.concat(F.lit("user"), F.col("l_partkey").cast("string"), F.lit(".mail@example.com")).alias("mail"), F.col("l_linenumber").alias("line"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))


def nested_array_anonymize(spark, sf_dir):
    df = Pipeline([{"type": "anonymize", "field": "items.mail", "operator": "mask_email"}]).apply(lines(spark, sf_dir)).df
    return df.select("l_orderkey", F.explode("items").alias("i")).select("l_orderkey", F.col("i.line").alias("line"), F.col("i.mail").alias("mail"))


QUERIES["nested_array_anonymize"] = nested_array_anonymize
ORACLES["nested_array_anonymize"] = "SELECT l_orderkey, l_linenumber AS line, 'us' || repeat('*', length('user' || l_partkey || '.mail') - 4) || 'il@example.com' AS mail FROM lineitem"


def wildcard_anonymize(spark, sf_dir):
    df = people(spark, sf_dir, "sin", "nick").select("c_custkey", F.struct(F.struct("sin").alias("forms"), F.struct(F.col("sin").alias("sin"), F.col("nick")).alias("profile")).alias("person"))
    out = Pipeline([{"type": "anonymize", "field": "person.*.sin", "operator": "redact"}]).apply(df).df
    return out.select("c_custkey", F.col("person.forms.sin").alias("a"), F.col("person.profile.sin").alias("b"), F.col("person.profile.nick").alias("nick"))


QUERIES["wildcard_anonymize"] = wildcard_anonymize
ORACLES["wildcard_anonymize"] = f"SELECT c_custkey, '' AS a, '' AS b, nick FROM {people_sql('sin', 'nick')}"


def stringified(spark, sf_dir):
    """Numbers and booleans become text when they are anonymized."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 2 == 0).alias("flag"))
    return Pipeline([{"type": "anonymize", "field": c, "operator": "keep"} for c in ("n", "flag")]).apply(df).df


QUERIES["anonymize_types"] = stringified
ORACLES["anonymize_types"] = "SELECT c_custkey, c_nationkey::VARCHAR AS n, CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS flag FROM customer"
