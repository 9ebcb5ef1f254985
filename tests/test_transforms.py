import pytest
from pyspark.sql import Row

from tarnflow.operators.transforms import Pipeline


def run(spark, rows, schema, steps, mode="skip"):
    result = Pipeline(steps, mode).apply(spark.createDataFrame(rows, schema))
    out = [r.asDict(recursive=True) for r in result.df.collect()]
    return out, result.statistics()


def test_field_steps_and_counts(spark):
    steps = [
        {"type": "add_field", "field": "tag", "value": "${first} ${last}"},
        {"type": "set_field", "field": "meta.source", "value": "import"},
        {"type": "rename_field", "from_field": "first", "to_field": "given"},
        {"type": "copy_field", "from_field": "given", "to_field": "copy"},
        {"type": "regex_replace", "field": "last", "pattern": r"^(\w)(\w*)$", "replacement": r"\2\1"},
        {"type": "remove_field", "field": ["gone", "absent"]},
    ]
    out, stats = run(spark, [("Ann", "Lee", 1), ("Bob", None, 2)], "first string, last string, gone int", steps)
    assert out[0] == {"given": "Ann", "last": "eeL", "tag": "Ann Lee", "meta": {"source": "import"}, "copy": "Ann"} | {}
    assert out[1]["tag"] == "Bob " and out[1]["last"] is None
    assert stats["operations"]["regex_replace"]["fields_processed"] == 1
    assert stats["operations"]["remove_field"]["fields_processed"] == 4
    assert stats["documents_failed"] == 0


def test_skip_keeps_original_and_fail_raises(spark):
    rows, schema = [("oak", 3), ("elm", None), ("fir", None)], "tree string, height int"
    steps = [{"type": "set_field", "field": "tree", "value": "T"}, {"type": "add_field", "field": "height", "value": 9}]
    out, stats = run(spark, rows, schema, steps)
    assert sorted((r["tree"], r["height"]) for r in out) == [("T", 9), ("T", 9), ("oak", 3)]
    assert (stats["documents_processed"], stats["documents_failed"]) == (2, 1)
    with pytest.raises(Exception, match="a transform failed"):
        run(spark, rows, schema, steps, "fail")


def test_remove_cleans_empty_parents(spark):
    out, _ = run(spark, [Row(a=Row(b=Row(c=1)), d=2)], None, [{"type": "remove_field", "field": "a.b.c"}])
    assert out == [{"d": 2}]


def test_conditions_and_anonymize_last(spark):
    steps = [
        {"type": "anonymize", "field": "email", "operator": "mask_email", "condition": {"field": "tier", "operator": "$ne", "value": "free"}},
        {"type": "set_field", "field": "email", "value": "robert@example.com"},
        {"type": "remove_field", "field": "x", "condition": {"field": "tier", "operator": "$eq", "value": "free"}},
    ]
    out, stats = run(spark, [("free", "a@b.co", 1), (None, "c@d.co", 2)], "tier string, email string, x int", steps)
    assert [(r["email"], r["x"]) for r in out] == [("robert@example.com", None), ("ro**rt@example.com", 2)]
    assert stats["operations"]["anonymize"]["fields_processed"] == 1
    assert stats["transforms_skipped"] == 2


def test_wildcards_arrays_and_types(spark):
    row = Row(user=Row(forms=Row(sin="123-456-789"), name="A"), phones=["555-123-4567", None, " "], n=123456789, people=[Row(mail="alice@example.com")])
    steps = [
        {"type": "anonymize", "field": "user.*.sin", "operator": "mask_sin"},
        {"type": "anonymize", "field": "phones", "operator": "mask_phone"},
        {"type": "anonymize", "field": "n", "operator": "hash", "params": {"salt": "s"}},
        {"type": "anonymize", "field": "people.mail", "operator": "mask_email"},
    ]
    out, _ = run(spark, [row], None, steps)
    assert out[0]["user"] == {"forms": {"sin": "***-***-789"}, "name": "A"}
    assert out[0]["phones"] == ["***-***-4567", None, " "]
    assert len(out[0]["n"]) == 64 and out[0]["people"] == [{"mail": "*****@example.com"}]


def test_wrong_steps_fail_at_plan_time(spark):
    for step in ({"type": "explode"}, {"type": "anonymize", "field": "a", "operator": "nope"}, {"type": "regex_replace", "field": "a", "pattern": "(", "replacement": ""}, {"type": "add_field", "field": "a"}):
        with pytest.raises(ValueError):
            Pipeline([step])


def test_parent_that_is_no_document_fails_the_row(spark):
    out, stats = run(spark, [("x",), (None,)], "a string", [{"type": "set_field", "field": "a.b", "value": 1}])
    assert [r["a"] for r in out] == ["x", None] and stats["documents_failed"] == 1


def test_fail_mode_raises_whatever_is_read(spark):
    df = spark.createDataFrame([("oak", 3, 1)], "tree string, height int, other int")
    out = Pipeline([{"type": "add_field", "field": "height", "value": 9}], "fail").apply(df).df
    for read in (lambda: out.select("other").collect(), out.count, lambda: out.select("tree").collect()):
        with pytest.raises(Exception, match="a transform failed"):
            read()


def test_nothing_passes_in_the_clear(spark):
    row = Row(user=Row(name="Ann", ids=[1, None], deep=Row(mail="ann@example.com")), tags={"a": "x", "b": None}, list=[{"k": Row(v="secret")}])
    steps = [{"type": "anonymize", "field": f, "operator": "redact"} for f in ("user", "tags.a", "list.k.v")]
    out, stats = run(spark, [row], None, steps)
    assert out == [{"user": {"name": "", "ids": ["", None], "deep": {"mail": ""}}, "tags": {"a": "", "b": None}, "list": [{"k": {"v": ""}}]}]
    assert stats["transforms_applied"] == 3
    for field in ("user.emial", "usr", "list.*.nothing", "user.name.first"):
        with pytest.raises(ValueError, match="no field"):
            Pipeline([{"type": "anonymize", "field": field, "operator": "redact"}]).apply(spark.createDataFrame([row]))


def test_made_up_values_need_the_salt_to_be_found(spark):
    df = spark.createDataFrame([("123-45-6789", "123-45-6789")], "a string, b string")
    steps = [{"type": "anonymize", "field": f, "operator": "fake_ssn"} for f in "ab"]
    first, second = (Pipeline(steps).apply(df).df.first() for _ in range(2))
    assert first.a == first.b and first.a != second.a
    fixed = [Pipeline([{**s, "params": {"salt": "s"}} for s in steps]).apply(df).df.first() for _ in range(2)]
    assert fixed[0] == fixed[1]
