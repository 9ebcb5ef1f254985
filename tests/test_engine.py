import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnflow import cli
from tarnflow.operators.cascade import cascade, typed_ids
from tarnflow.operators.relationships import Relationship, RelationshipGraph, infer_from_schemas, render_tree
from tarnflow.operators.sampling import sample
from tarnflow.plans.config import Config, LoadConfig, ScanConfig, deep_merge, dump_config, load_config
from tarnflow.plans.runner import Runner, parse_ids, parse_query
from tarnflow.plans.scan import report, scan
from tarnflow.sources.catalog import FolderCatalog, check_apart, discover
from tarnflow.sources.indexes import Index, replicable, replicate
from tarnflow.sources.jobs import get_job, jobs
from tarnflow.sources.sinks import DuplicateKeyError, error_text, write
from tarnflow.sources.state import StateStore

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def shop(spark, tmp_path):
    """customers, orders and items as tables in a folder."""
    root = str(tmp_path / "shop")
    spark.createDataFrame([Row(_id=f"c{i}", email=f"person{i}@mail.example.com", plan="pro" if i % 2 else "free", updated_at=T0 + dt.timedelta(days=i)) for i in range(6)]).write.parquet(f"{root}/customers.parquet")
    spark.createDataFrame([Row(_id=f"o{i}", customer_id=f"c{i % 6}", updated_at=T0 + dt.timedelta(days=i)) for i in range(12)]).write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([Row(_id=f"i{i}", order_id=f"o{i % 12}") for i in range(24)]).write.parquet(f"{root}/items.parquet")
    return FolderCatalog(spark, root)


GRAPH = [Relationship("customers", "orders", "_id", "customer_id"), Relationship("orders", "items", "_id", "order_id")]


def test_graph():
    g = RelationshipGraph(GRAPH)
    assert g.descendants("customers") == ["customers", "orders", "items"] and not g.has_cycles()
    assert g.missing(["customers", "orders"]) == ["items"]
    assert render_tree(g.tree("customers"), {"orders": 3}) == "customers\n└── orders (3 rows) via customer_id\n    └── items via order_id"
    assert RelationshipGraph([Relationship("a", "b", "_id", "x"), Relationship("b", "a", "_id", "y")]).has_cycles()
    with pytest.raises(ValueError, match="two parents"):
        RelationshipGraph([*GRAPH, Relationship("items", "orders", "_id", "z")])
    with pytest.raises(ValueError):
        Relationship("a", "a", "_id", "x")


def test_cascade(shop):
    g = RelationshipGraph(GRAPH)
    c = cascade(g, shop.load, "customers", ids=["c1", "c2", "none"])
    assert c.counts() == {"customers": 2, "orders": 4, "items": 8}
    assert cascade(g, shop.load, "customers", query={"plan": "gone"}).skipped() == ["orders", "items"]
    with pytest.raises(ValueError):
        cascade(g, shop.load, "customers")
    assert typed_ids(shop.load("items").schema["_id"].dataType, [1]) == ["1"]


def test_options():
    assert parse_ids("c=1, 2,") == ("c", ["1", "2"]) and parse_query('c={"a": 1}') == ("c", {"a": 1})
    for bad in ("c", "=1", "c="):
        with pytest.raises(ValueError):
            parse_ids(bad)
    for bad in ("c", "c=[1]", "c={", '={"a":1}'):
        with pytest.raises(ValueError):
            parse_query(bad)


def test_inference(spark):
    s = {n: spark.createDataFrame([], f).schema for n, f in {"customers": "_id string, name string", "orders": "_id string, meta struct<customerId:string>", "categories": "_id string", "products": "category_id string, product_id string"}.items()}
    assert infer_from_schemas(spark, s) == [Relationship("customers", "orders", "_id", "meta.customerId"), Relationship("categories", "products", "_id", "category_id")]


def test_dispositions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "_id int, v string, at int")
    rows = lambda: sorted(map(tuple, spark.read.parquet(path).collect()))
    write(frame((1, "a", 1), (1, "b", 2)), path, "merge", cursor="at")
    assert rows() == [(1, "b", 2)]
    write(frame((1, "c", 3), (2, "d", 1)).withColumn("extra", F.lit(1)), path, "merge", cursor="at")
    assert rows() == [(1, "c", 3, 1), (2, "d", 1, 1)]
    write(frame((1, "x", 1)), path, "replace")
    for bad in (frame((1, "y", 1)), frame((5, "y", 1), (5, "z", 1))):
        with pytest.raises(DuplicateKeyError):
            write(bad, path, "append")
    write(frame((2, "y", 1)), path, "append")
    assert rows() == [(1, "x", 1), (2, "y", 1)]
    write(frame((1, "x", 1)).limit(0), path, "replace")
    assert rows() == []
    with pytest.raises(ValueError):
        write(frame((1, "x", 1)), path, "upsert")


def test_errors_in_short():
    text = error_text([(11000, 'E11000 dup key: { _id: "a" }\nmore'), (11000, "again"), (121, "bad")])
    assert text == "code 11000: 2 error(s), e.g. E11000 dup key: { ... }; code 121: 1 error(s), e.g. bad"


def test_indexes(spark):
    specs = [{"name": "_id_", "key": {"_id": 1}}, {"name": "u", "key": {"a": 1, "b": -1}, "unique": True, "sparse": True}, {"name": "t", "key": {"at": 1}, "expireAfterSeconds": 60}, {"name": "x", "key": {"t": "text"}}]
    assert [i.name for i in replicable(specs)] == ["u", "t", "x"]
    assert Index.of(specs[1]).describe() == "u (a: 1, b: -1; unique; sparse)"
    df = spark.createDataFrame([(1, 1), (1, 1), (None, None), (None, None)], "a int, b int")
    good, failed, messages = replicate(spark, df, specs)
    assert (good, failed) == (2, 1) and "duplicate" in messages[0]


def test_state(spark, tmp_path):
    s = StateStore(spark, str(tmp_path))
    run = s.create_run()
    assert s.running_runs().count() == 1 and s.last_successful_run() is None
    for value in (dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1)):
        key = s.start_collection(run, "c")
        s.complete_collection(key, {"processed": 1, "succeeded": 1, "failed": 0}, (value.isoformat(), "timestamp", "at"))
    key = s.start_collection(run, "c")
    s.fail_collection(key, "boom")
    assert s.last_cursor("c") == dt.datetime(2024, 3, 1) and s.failed_collections(run).count() == 1
    s.complete_run(run, {"processed": 1, "succeeded": 1, "failed": 0}, {"processed": 2, "succeeded": 2, "failed": 0}, {"c": "boom"})
    assert s.last_successful_run()["errors"]["collections"] == ["c"]
    s.reset_collection("c")
    assert s.last_cursor("c") is None and s.collections().count() == 0


def test_discovery_and_places():
    d = discover(["a1", "b", "_rep", "tmp"], False, ("^a", "b"), ("b$",), ("_rep",), ("a1",))
    assert (d.included, d.excluded, d.configured, d.auto_discovered) == (["a1"], ["_rep", "b", "tmp"], ["a1"], [])
    assert discover(["a"], False).included == []
    for same in (("/data/x/", "file:///data//x"), ("hdfs://Host/a", "hdfs://host/a/")):
        with pytest.raises(ValueError):
            check_apart(*same)
    check_apart("/data/x", "/data/y")


def test_jobs():
    env = {"FLOW_A_ENABLED": "Yes", "FLOW_A_SOURCE_URI": "/in", "FLOW_A_DESTINATION_URI": "s3a://b/out", "FLOW_B_ENABLED": "0"}
    assert list(jobs(env)) == ["a"] and get_job("a", env).destination_uri == "s3a://b/out"
    for change in ({"FLOW_A_ENABLED": "no"}, {"FLOW_A_SOURCE_URI": ""}, {"FLOW_A_DESTINATION_URI": "/in/"}):
        with pytest.raises(ValueError):
            get_job("a", env | change)


def test_config():
    text = "replication:\n  defaults: {write_disposition: append, cursor_initial_value: '2021-01-01T02:00:00+02:00'}\n  collections:\n    c:\n      cursor_field: at\n      transforms:\n        - {type: rename_field, from_field: a, to_field: b, overwrite: true}\n"
    c = load_config(text=text)
    own = c.replication.of("c")
    assert (own.cursor_field, own.write_disposition, own.cursor_initial_value) == ("at", "append", dt.datetime(2021, 1, 1))
    assert c.replication.of("other").write_disposition == "append"
    assert load_config(text=dump_config(c)) == c
    pii = load_config(text="scan: {pii_analysis: {anonymization_operators: {PERSON: {operator: cover, params: {masking_char: '#'}}}, custom_strategy_aliases: {cover: mask}}}").scan.pii_analysis
    assert pii.step("a", "PERSON", "redact") == {"type": "anonymize", "field": "a", "operator": "mask", "params": {"masking_char": "#", "entity_type": "PERSON"}}
    assert pii.step("a", "URL", "redact")["operator"] == "redact"
    assert deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    for bad in ("{}", "scan: {sampling: {sample_size: 0}}", "replication: {defaults: {cursor_initial_value: soon}}", "replication: {collections: {c: {transforms: [{type: x}]}}}", "schema_relationships: [{parent: a, child: a, child_field: x}]\nscan: {}", "[1]"):
        with pytest.raises(ValueError):
            load_config(text=bad)


def test_runs(spark, shop, tmp_path):
    steps = [{"type": "anonymize", "field": "email", "operator": "mask_email"}]
    config = Config(
        replication=LoadConfig(collections={"customers": {"cursor_field": "updated_at", "transforms": steps}, "orders": {"cursor_field": "updated_at", "write_disposition": "append", "match": {"customer_id": {"$ne": "c0"}}}, "items": {"enabled": False}}),
        schema_relationships=[{"parent": r.parent, "child": r.child, "child_field": r.child_field} for r in GRAPH],
    )
    out = FolderCatalog(spark, str(tmp_path / "out"))
    seen = []
    runner = Runner(spark, shop, out, config, progress=lambda n, s, d: seen.append((n, s)))
    assert {o.collection: o.documents for o in runner.run(dry_run=True).outcomes} == {"customers": 6, "orders": 10}
    first = runner.run()
    assert not first.failed and sorted(seen) == [("customers", "completed"), ("orders", "completed")]
    assert out.load("customers").where("email like 'pe%@mail.example.com'").count() == 6 and not out.has("items")
    assert out.load("customers").where("email like '%person%'").count() == 0
    new = spark.createDataFrame([Row(_id="c0", email="z@z.example", plan="x", updated_at=T0 + dt.timedelta(days=90))])
    new.write.mode("append").parquet(shop.path("customers"))
    second = runner.run()
    by = {o.collection: o for o in second.outcomes}
    assert by["customers"].documents == 1 and out.load("customers").count() == 6
    assert (by["orders"].status, by["orders"].documents) == ("completed", 0)
    third = runner.run(ids=("customers", ["c1"]))
    assert {o.collection: o.documents for o in third.outcomes} == {"customers": 1, "orders": 2, "items": 4}
    assert out.load("items").count() == 4 and runner.state.runs().count() == 3
    with pytest.raises(ValueError):
        runner.run(["nothing"])
    with pytest.raises(ValueError):
        runner.run(["orders"], ids=("customers", ["c1"]))


def test_scan_and_report(spark, shop):
    config = Config(scan=ScanConfig(schema_relationships={"enabled": True}))
    result = scan(spark, shop, config)
    one = {s.name: s for s in result.collections}["customers"]
    assert (one.cursor, one.total, one.strategy) == ("updated_at", 6, "all")
    assert [(f["path"], f["entity"], f["strategy"]) for f in one.findings] == [("email", "EMAIL_ADDRESS", "smart_mask")]
    assert {(r.parent, r.child) for r in result.relationships} == {("customers", "orders"), ("orders", "items")}
    text = report(result)
    assert "| email | EMAIL_ADDRESS |" in text and "customers._id -> orders.customer_id" in text
    again = scan(spark, shop, result.config).config
    assert again.replication.collections["customers"] == result.config.replication.collections["customers"]
    assert load_config(text=dump_config(again)).schema_relationships == again.schema_relationships


def test_samples(spark):
    df = spark.range(100).select("id", (F.lit(T0) + F.make_dt_interval(F.col("id").cast("int"))).alias("updatedAt"))
    s = sample(df, 11)
    assert s.strategy == "stratified" and sorted(r.id for r in s.df.collect()) == [0, 1, 2, 3, 4, 95, 96, 97, 98, 99]
    assert sample(df, 7, "random").df.count() == 7 and sample(df.limit(0), 7).strategy == "empty" and sample(df.drop("updatedAt"), 7).strategy == "random"


def test_command_line(spark, shop, tmp_path, capsys):
    out, config = str(tmp_path / "cli"), str(tmp_path / "c.yaml")
    assert cli.main(["init", "--source", shop.root, "--destination", out, "--config", config]) == 0
    assert cli.main(["init", "--source", shop.root, "--destination", out, "--config", config]) == 2
    assert cli.main(["scan", "--source", shop.root, "--config", config, "--output", config], spark) == 0
    assert "Scan report" in capsys.readouterr().out
    assert cli.main(["run", "--source", shop.root, "--destination", out, "--config", config, "--collections", "customers"], spark) == 0
    assert FolderCatalog(spark, out).load("customers").count() == 6
    assert cli.main(["run", "--source", shop.root, "--destination", shop.root], spark) == 2
    assert cli.main(["run", "--source", shop.root, "--destination", out, "--query", 'customers={}', "--dry-run"], spark) == 0
    assert "nothing was written" in capsys.readouterr().out


def test_merge_refuses_rows_without_a_key_and_takes_the_newest(spark):
    from tarnflow.sources.sinks import latest, merged

    rows = spark.createDataFrame([(k, (v,)) for k in range(50) for v in random.Random(k).sample(range(9), 9)], "k int, meta struct<at:int>")
    assert {r.meta.at for r in latest(rows, "k", "meta.at").collect()} == {8}
    with pytest.raises(Exception, match="no k"):
        merged(rows, rows.unionByName(spark.createDataFrame([(None, (1,))], rows.schema)), "k").collect()


def test_streams_append_once_and_refuse_replace(spark, tmp_path):
    from tarnflow.streaming.incremental import load_stream

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.range(5).selectExpr("id AS k", "id * 2 AS v")
    df.write.parquet(src)
    load_stream(spark, src, df.schema, out, str(tmp_path / "c1"), key="k", disposition="append")
    # a checkpoint lost after the write: the batch runs again
    load_stream(spark, src, df.schema, out, str(tmp_path / "c2"), key="k", disposition="append")
    assert spark.read.parquet(out).count() == 5
    with pytest.raises(ValueError, match="merges or appends"):
        load_stream(spark, src, df.schema, out, str(tmp_path / "c3"), key="k", disposition="replace")


def test_cursors_keep_their_type():
    import datetime as dt
    import decimal

    from tarnflow.sources.state import cursor_text, cursor_value

    for value, kind in ((decimal.Decimal("12345678901234567.89"), "decimal(20,2)"), (7, "bigint"), (0.5, "double"), ("x", "string"), (dt.datetime(2024, 1, 2, 3), "timestamp_ntz")):
        assert cursor_value(cursor_text(value, kind), kind) == value
    local = dt.datetime(2024, 1, 2, 3)
    assert cursor_value(cursor_text(local, "timestamp"), "timestamp") == local.astimezone(dt.timezone.utc)
    assert cursor_text(local, "timestamp").endswith("+00:00")


def test_array_references_join_by_key(spark):
    from tarnflow.operators.cascade import related

    child = spark.createDataFrame([(1, [1, 2, 2]), (2, [9]), (3, None), (4, [2, 1]), (4, [2, 1])], "c int, refs array<int>")
    out = related(spark.createDataFrame([(1,), (2,), (2,)], "k int"), child, "k", "refs")
    assert sorted(r.c for r in out.collect()) == [1, 4, 4]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_exports_load():
    import tarnflow

    assert all(getattr(tarnflow, name) is not None for name in tarnflow.__all__)
    with pytest.raises(AttributeError):
        tarnflow.nothing  # noqa: B018


def test_entry_survives_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("tarnflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)  # a third-party module that cannot be imported
    with pytest.warns(UserWarning, match="left out"):
        entry = importlib.reload(__spark_entry__)
    assert len(entry.queries()) > 140 and not any(k.startswith("op1_") for k in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_state_tables_are_compacted(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    run = store.create_run()
    for name in ("a", "b"):
        store.complete_collection(store.start_collection(run, name), {"processed": 3, "succeeded": 3, "failed": 0}, ("7", "bigint", "k"))
    store.reset_collection("b")
    before = sorted(map(str, store.collections().collect()))
    assert store.compact(1000) == [] and len(store.compact(2)) == 1
    assert sorted(map(str, store.collections().collect())) == before
    assert len(list((tmp_path / "_rep_state").glob("*.parquet"))) == 1
    store.complete_run(run, {"processed": 2, "succeeded": 2, "failed": 0}, {"processed": 6, "succeeded": 6, "failed": 0})
    assert store.last_cursor("a") == 7 and store.last_cursor("b") is None and store.runs().first().status == "completed"


def test_csv_keeps_its_names(spark, tmp_path):
    path, options = str(tmp_path / "t"), {"header": "true", "inferSchema": "true"}
    for rows in ([(1, "a"), (2, "b")], [(2, "c")]):
        write(spark.createDataFrame(rows, "k int, v string"), path, "merge", "k", format="csv", options=options)
    got = spark.read.options(**options).csv(path)
    assert got.columns == ["k", "v"] and sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c")]


def test_a_cursor_has_values(spark):
    from tarnflow.operators.detect import cursor_with_values

    df = spark.createDataFrame([(None, 1, (2,))], "updated_at int, k int, meta struct<UpdatedAt:int>")
    assert cursor_with_values(df, ["updated_at", "updatedAt", "meta.updatedAt"]) == "meta.updatedAt"
    assert cursor_with_values(df, ["updated_at"]) is None and cursor_with_values(df, ["nothing"]) is None
