"""Queries of the document filters and the incremental predicate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tarnflow.operators.filters import incremental, matched
from tarnflow.plans.samples import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def match(name: str, source: str, columns: str, spec: dict, sql: str) -> None:
    QUERIES[name] = lambda spark, d: matched(table(spark, d, source), spec).select(*[c.strip() for c in columns.split(",")])
    ORACLES[name] = f"SELECT {columns} FROM {source} WHERE {sql}"


C = "c_custkey, c_mktsegment"
match("match_eq", "customer", C, {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'")
match("match_ne", "customer", C, {"c_mktsegment": {"$ne": "BUILDING"}}, "c_mktsegment <> 'BUILDING'")
match("match_in", "customer", C, {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
match("match_nin", "customer", C, {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
match("match_in_empty", "customer", C, {"c_mktsegment": {"$in": []}}, "false")
match("match_range", "orders", "o_orderkey, o_totalprice", {"o_totalprice": {"$gte": 1000, "$lt": 50000.5}}, "o_totalprice >= 1000 AND o_totalprice < 50000.5")
match("match_date", "orders", "o_orderkey", {"o_orderdate": {"$gt": "1997-01-01T00:00:00Z"}}, "o_orderdate > TIMESTAMP '1997-01-01'")
match("match_regex", "customer", C, {"c_name": {"$regex": "[13579]$"}, "c_mktsegment": {"$regex": "^b", "$options": "i"}}, "regexp_matches(c_name, '[13579]$') AND regexp_matches(c_mktsegment, '(?i)^b')")
match("match_and_or", "orders", "o_orderkey", {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, {"$and": [{"o_orderpriority": "1-URGENT"}, {"o_orderstatus": {"$ne": "O"}}]}]}, "(o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O')")
match("match_nor", "orders", "o_orderkey", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 100000}}]}, "NOT (o_orderstatus = 'F' OR o_totalprice < 100000)")
match("match_not", "part", "p_partkey", {"p_size": {"$not": {"$gte": 10, "$lte": 40}}}, "NOT (p_size >= 10 AND p_size <= 40)")
match("match_mod", "orders", "o_orderkey", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3")
match("match_type", "orders", "o_orderkey", {"o_orderdate": {"$type": "date"}, "o_orderkey": {"$type": ["string", "long"]}}, "true")
match("match_incomparable", "orders", "o_orderkey", {"o_totalprice": {"$gt": "abc"}}, "false")


def shaped(spark, sf_dir):
    """Parts with a nullable field, a nested document and arrays."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size % 5 != 0, size).alias("size"),
        F.struct(F.col("p_brand").alias("brand"), F.struct(size.alias("n")).alias("deep")).alias("info"),
        F.array(F.concat(F.lit("t"), (size % 3).cast("string")), F.concat(F.lit("t"), (size % 4).cast("string"))).alias("tags"),
        F.array(F.struct(F.lit("a").alias("k"), size.alias("v")), F.struct(F.lit("b").alias("k"), (size * 2).alias("v"))).alias("items"),
    )


def shaped_match(name: str, spec: dict, sql: str) -> None:
    QUERIES[name] = lambda spark, d: matched(shaped(spark, d), spec).select("p_partkey")
    ORACLES[name] = f"SELECT p_partkey FROM part WHERE {sql}"


shaped_match("match_exists", {"size": {"$exists": True}}, "p_size % 5 <> 0")
shaped_match("match_not_exists", {"size": {"$exists": False}}, "p_size % 5 = 0")
shaped_match("match_null", {"size": None}, "p_size % 5 = 0")
shaped_match("match_ne_null_rows", {"size": {"$ne": 7}}, "p_size % 5 = 0 OR p_size <> 7")
shaped_match("match_nested", {"info.deep.n": {"$lt": 10}, "info.brand": {"$regex": "1"}}, "p_size < 10 AND contains(p_brand, '1')")
shaped_match("match_array_value", {"tags": "t0"}, "p_size % 3 = 0 OR p_size % 4 = 0")
shaped_match("match_array_in", {"tags": {"$in": ["t3", "t2"]}}, "p_size % 3 = 2 OR p_size % 4 IN (2, 3)")
shaped_match("match_all", {"tags": {"$all": ["t0", "t1"]}}, "(p_size % 3 = 0 AND p_size % 4 = 1) OR (p_size % 3 = 1 AND p_size % 4 = 0)")
shaped_match("match_size", {"tags": {"$size": 2}, "items": {"$size": 2}}, "true")
shaped_match("match_elem", {"items": {"$elemMatch": {"k": "b", "v": {"$gt": 60}}}}, "p_size * 2 > 60")
shaped_match("match_items_path", {"items.v": {"$gt": 90}}, "p_size * 2 > 90")

LAST = dt.datetime(1997, 6, 1)


def cursor_rows(spark, sf_dir):
    when = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 10 != 0, when).alias("at"))


QUERIES["incremental_cursor"] = lambda spark, d: (lambda df: df.where(incremental(df.schema, "at", LAST, {"o_orderstatus": "O"})).select("o_orderkey"))(cursor_rows(spark, d))
ORACLES["incremental_cursor"] = "SELECT o_orderkey FROM orders WHERE (o_orderkey % 10 = 0 OR o_orderdate > TIMESTAMP '1997-06-01') AND o_orderstatus = 'O'"
QUERIES["incremental_first_load"] = lambda spark, d: (lambda df: df.where(incremental(df.schema, "at", None, {"o_orderstatus": "O"})).select("o_orderkey"))(cursor_rows(spark, d))
ORACLES["incremental_first_load"] = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"
QUERIES["incremental_other_type"] = lambda spark, d: (lambda df: df.where(incremental(df.schema, "o_orderkey", LAST)).select("o_orderkey"))(cursor_rows(spark, d))
ORACLES["incremental_other_type"] = "SELECT o_orderkey FROM orders"
