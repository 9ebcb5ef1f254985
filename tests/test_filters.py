import datetime as dt

import pytest
from pyspark.sql import Row

from tarnflow.operators.conditions import condition
from tarnflow.operators.filters import compile_filter, incremental

ROWS = [
    Row(i=1, s="active", age=20, tags=["a", "b"], addr=Row(city="Rome"), items=[Row(k="x", n=1)], at=dt.datetime(2024, 1, 1)),
    Row(i=2, s="idle", age=None, tags=["c"], addr=Row(city="Paris"), items=[Row(k="y", n=5), Row(k="x", n=7)], at=None),
    Row(i=3, s=None, age=40, tags=None, addr=None, items=None, at=dt.datetime(2024, 6, 1)),
]


@pytest.mark.parametrize(
    "spec, ids",
    [
        ({}, {1, 2, 3}),
        ({"s": "active"}, {1}),
        ({"s": None}, {3}),
        ({"s": {"$ne": "active"}}, {2, 3}),
        ({"age": {"$gte": 20, "$lt": 40}}, {1}),
        ({"age": {"$gt": "x"}}, set()),
        ({"s": {"$in": ["idle", None]}}, {2, 3}),
        ({"s": {"$in": []}}, set()),
        ({"s": {"$nin": ["idle"]}}, {1, 3}),
        ({"age": {"$exists": False}}, {2}),
        ({"s": {"$regex": "^ACT", "$options": "i"}}, {1}),
        ({"addr.city": "Paris"}, {2}),
        ({"tags": "a"}, {1}),
        ({"tags": ["a", "b"]}, {1}),
        ({"tags": {"$all": ["a", "b"]}}, {1}),
        ({"tags": {"$size": 1}}, {2}),
        ({"items.n": {"$gt": 6}}, {2}),
        ({"items": {"$elemMatch": {"k": "x", "n": {"$gt": 3}}}}, {2}),
        ({"tags": {"$elemMatch": {"$in": ["b"]}}}, {1}),
        ({"age": {"$mod": [20, 0]}}, {1, 3}),
        ({"age": {"$not": {"$gt": 30}}}, {1, 2}),
        ({"$or": [{"s": "idle"}, {"age": 40}]}, {2, 3}),
        ({"$nor": [{"s": "idle"}, {"age": 40}]}, {1}),
        ({"$and": [{"s": "active"}, {"age": 20}]}, {1}),
        ({"at": {"$type": "date"}}, {1, 3}),
        ({"nothing": None}, {1, 2, 3}),
        ({"nothing": 1}, set()),
        ({"at": {"$gt": "2024-03-01T00:00:00Z"}}, {3}),
        ({"addr": {"city": "Rome"}}, {1}),
    ],
)
def test_filters(spark, spec, ids):
    df = spark.createDataFrame(ROWS)
    assert {r.i for r in df.where(compile_filter(spec, df.schema)).collect()} == ids


def test_unknown_operators_are_errors(spark):
    df = spark.createDataFrame(ROWS)
    for spec in ({"s": {"$near": 1}}, {"$where": "x"}):
        with pytest.raises(ValueError):
            compile_filter(spec, df.schema)


def test_incremental(spark):
    df = spark.createDataFrame(ROWS)
    ids = lambda c: {r.i for r in df.where(c).collect()}
    assert ids(incremental(df.schema, "at", dt.datetime(2024, 2, 1))) == {2, 3}
    assert ids(incremental(df.schema, "at", dt.datetime(2024, 2, 1), {"s": "idle"})) == {2}
    assert ids(incremental(df.schema, "at", "not a date of this kind" if False else None, {"s": "idle"})) == {2}
    assert ids(incremental(df.schema, "s", dt.datetime(2024, 2, 1))) == {1, 2, 3}


def test_pushdown(spark, tmp_path):
    df = spark.createDataFrame(ROWS).select("i", "s", "age")
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = t.where(compile_filter({"age": {"$gt": 3}, "s": {"$ne": "x"}}, t.schema))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,3)" in plan and "Not(EqualNullSafe(s,x))" in plan


@pytest.mark.parametrize(
    "op, value, ids",
    [("$exists", True, {1, 3}), ("$exists", False, {2}), ("$eq", 20, {1}), ("$ne", 20, {2, 3}), ("$gt", 20, {3}), ("$gte", 20, {1, 3}), ("$lt", 40, {1}), ("$lte", 40, {1, 3}), ("$in", [20, None], {1, 2}), ("$nin", [20], {2, 3})],
)
def test_conditions(spark, op, value, ids):
    df = spark.createDataFrame(ROWS)
    assert {r.i for r in df.where(condition(df.schema, {"field": "age", "operator": op, "value": value})).collect()} == ids
