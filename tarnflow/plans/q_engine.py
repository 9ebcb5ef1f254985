"""Queries of whole runs: loads through the runner, their states, plans, and the choices made on the way."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tarnflow.operators.anonymize import anonymize_text, operators_for, supported_entities
from tarnflow.operators.relationships import Relationship, RelationshipGraph, render_tree
from tarnflow.operators.sampling import date_field
from tarnflow.plans.config import CollectionConfig, Config, LoadConfig, RelationshipConfig, deep_merge, load_config
from tarnflow.plans.q_related import scratch
from tarnflow.plans.runner import Runner, parse_ids, parse_query, usable_cursor
from tarnflow.plans.samples import table
from tarnflow.sources.catalog import FolderCatalog
from tarnflow.sources.jobs import jobs
from tarnflow.sources.state import cursor_text, cursor_value

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEYS = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
LINKS = [("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
RICH = {"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 5000}}


def config(**collections: dict) -> Config:
    own = {n: CollectionConfig(primary_key=k, **collections.get(n, {})) for n, k in KEYS.items()}
    links = [RelationshipConfig(parent=p, child=c, parent_field=pf, child_field=cf) for p, pf, c, cf in LINKS]
    return Config(replication=LoadConfig(collections=own), schema_relationships=links)


def runner(spark, sf_dir, **collections: dict) -> Runner:
    return Runner(spark, FolderCatalog(spark, sf_dir), FolderCatalog(spark, scratch(spark)), config(**collections))


def rows(spark, data: list, schema: str):
    return spark.createDataFrame(data, schema)


SELECTED = (
    "WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000), o AS (SELECT orders.* FROM orders JOIN c ON o_custkey = c_custkey), "
    "l AS (SELECT lineitem.* FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey), n AS (SELECT 'customer' AS collection, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l) "
)


def run_cascade(spark, sf_dir):
    """Rows of a query's root and all that belong to them, loaded by the runner and read from the destination."""
    r = runner(spark, sf_dir)
    r.run(query=("customer", RICH))
    return rows(spark, [(n, r.destination.load(n).count()) for n in r.destination.names() if n in KEYS], "collection string, n bigint")


QUERIES["run_cascade"], ORACLES["run_cascade"] = run_cascade, SELECTED + "SELECT * FROM n"


def run_states(spark, sf_dir):
    """What the state tables hold after a run in which one collection fails."""
    r = runner(spark, sf_dir, orders={"transforms": [{"type": "anonymize", "field": "o_nothing", "operator": "redact"}]})
    result = r.run(query=("customer", RICH))
    assert r.state.running_runs().count() == 0 and r.state.last_successful_run()["_id"] == result.run_id
    done = r.state.collections()
    return done.select("collection", "status", F.coalesce(F.col("documents.processed"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("error.message").contains("no field"), F.lit(False)).alias("told"))


QUERIES["run_states"] = run_states
ORACLES["run_states"] = SELECTED + "SELECT collection, CASE WHEN collection = 'orders' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN collection = 'orders' THEN 0 ELSE n END AS n, collection = 'orders' AS told FROM n"


def run_dry(spark, sf_dir):
    r = runner(spark, sf_dir)
    result = r.run(query=("customer", RICH), dry_run=True)
    assert not r.destination.names()
    return rows(spark, [(o.collection, o.status, o.documents) for o in result.outcomes], "collection string, status string, n bigint")


QUERIES["run_dry"], ORACLES["run_dry"] = run_dry, SELECTED + "SELECT collection, 'planned' AS status, n FROM n"


def run_incremental(spark, sf_dir):
    """A first load takes all, a second what lies beyond the first's position, and a reset makes it a first one again."""
    r, out = runner(spark, sf_dir, events={"cursor_field": "ts", "match": {"event_type": {"$ne": "error"}}, "cursor_initial_value": None}), []
    for turn in range(3):
        out.append((turn, r.run(["events"]).documents, r.destination.load("events").count()))
        if turn:
            r.state.reset_collection("events")
    return rows(spark, out, "turn int, loaded bigint, stored bigint")


QUERIES["run_incremental"] = run_incremental
ORACLES["run_incremental"] = "SELECT turn::INTEGER AS turn, CASE WHEN turn = 1 THEN 0 ELSE n END AS loaded, n AS stored FROM (SELECT count(*) AS n FROM events WHERE event_type <> 'error'), range(3) t(turn)"


def run_cursor(spark, sf_dir):
    """The position that a load keeps, as its type."""
    r = runner(spark, sf_dir, events={"cursor_field": "ts"})
    r.run(["events"])
    last = r.state.last_cursor("events")
    return rows(spark, [(last,)], "last timestamp").select("last")


QUERIES["run_cursor"], ORACLES["run_cursor"] = run_cursor, "SELECT max(ts) AS last FROM events"


def cursor_validation(spark, sf_dir):
    """The configured cursor if it has values, else the fallback, else none; replace needs none."""
    df = table(spark, sf_dir, "orders").withColumn("empty", F.lit(None).cast("timestamp"))
    cases = [("o_orderdate", "_id", "merge"), ("absent", "o_orderkey", "merge"), ("empty", "o_orderkey", "append"), ("empty", "absent", "merge"), ("o_orderdate", "_id", "replace")]
    out = [(c, f, d, usable_cursor(df, CollectionConfig(cursor_field=c, cursor_fallback_field=f, write_disposition=d))) for c, f, d in cases]
    return rows(spark, out, "field string, fallback string, disposition string, used string")


QUERIES["cursor_validation"] = cursor_validation
ORACLES["cursor_validation"] = (
    "SELECT * FROM (VALUES ('o_orderdate', '_id', 'merge', 'o_orderdate'), ('absent', 'o_orderkey', 'merge', 'o_orderkey'), ('empty', 'o_orderkey', 'append', 'o_orderkey'), ('empty', 'absent', 'merge', ''), "
    "('o_orderdate', '_id', 'replace', '')) t(field, fallback, disposition, used)"
)


def date_fields(spark, sf_dir):
    """The first candidate of a date type that has a value, by table."""
    wanted = ("created", "l_shipdate", "o_orderdate", "ts")
    frames = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "events", "part")}
    frames["dated"] = frames["orders"].withColumn("created", F.lit(None).cast("timestamp"))
    return rows(spark, [(n, date_field(df, wanted)) for n, df in frames.items()], "collection string, field string")


QUERIES["date_fields"] = date_fields
ORACLES["date_fields"] = "SELECT * FROM (VALUES ('lineitem', 'l_shipdate'), ('orders', 'o_orderdate'), ('events', 'ts'), ('part', NULL), ('dated', 'o_orderdate')) t(collection, field)"


def graph_checks(spark, sf_dir):
    links = [Relationship(p, c, pf, cf) for p, pf, c, cf in LINKS]
    g, loop = RelationshipGraph(links), RelationshipGraph([*links, Relationship("lineitem", "nation", "l_orderkey", "n_nationkey")])
    out = [("below customer", ",".join(g.descendants("customer"))), ("missing", ",".join(g.missing(["customer", "orders"]))), ("cycle", str(g.has_cycles())), ("cycle of a loop", str(loop.has_cycles())), ("tree", render_tree(g.tree("orders"), {"orders": 7}))]
    return rows(spark, out, "question string, answer string")


QUERIES["graph_checks"] = graph_checks
ORACLES["graph_checks"] = (
    "SELECT * FROM (VALUES ('below customer', 'customer,orders,lineitem'), ('missing', 'lineitem,nation'), ('cycle', 'False'), ('cycle of a loop', 'True'), ('tree', 'orders (7 rows)' || chr(10) || '└── lineitem via l_orderkey')) t(question, answer)"
)


def listing(spark, sf_dir):
    """The collections of a folder with their rows."""
    catalog = FolderCatalog(spark, sf_dir)
    return rows(spark, [(n, catalog.load(n).count()) for n in catalog.names() if n in ("region", *KEYS)], "collection string, n bigint")


QUERIES["listing"] = listing
ORACLES["listing"] = " UNION ALL ".join(f"SELECT '{n}' AS collection, count(*) AS n FROM {n}" for n in ("region", *KEYS))


def settings(spark, sf_dir):
    """Configuration: defaults below what is set, ISO dates in UTC, what is refused; options of the command line; jobs of the environment."""
    c = load_config(text="replication:\n  collections:\n    a: {cursor_initial_value: '2024-03-01T02:00:00+02:00', write_disposition: append}\n", defaults={"replication": {"defaults": {"primary_key": "k"}, "collections": {"a": {"batch_size": 7}}}}).replication
    a = c.of("a")

    def refused(f) -> str:
        try:
            f()
            return "taken"
        except ValueError:
            return "refused"

    env = {"FLOW_A_ENABLED": "true", "FLOW_A_SOURCE_URI": "/data/a", "FLOW_A_DESTINATION_URI": "/data/b", "FLOW_B_ENABLED": "no"}
    same = {**env, "FLOW_A_DESTINATION_URI": "file:///data//a/"}
    moment = dt.datetime(2024, 1, 2, 3, 4, 5)
    out = [
        ("iso date", str(a.cursor_initial_value)),
        ("merged", f"{a.primary_key},{a.batch_size},{a.write_disposition},{c.of('b').write_disposition}"),
        ("deep merge", str(deep_merge({"x": {"y": 1, "z": [1]}}, {"x": {"z": [2]}}))),
        ("bad date", refused(lambda: load_config(text="replication: {collections: {a: {cursor_initial_value: soon}}}"))),
        ("bad step", refused(lambda: load_config(text="replication: {collections: {a: {transforms: [{type: anonymize, field: f, operator: hide}]}}}"))),
        ("ids", str(parse_ids("a= 1,2 ,"))),
        ("query", str(parse_query('a={"x": {"$gt": 1}}'))),
        ("bad query", refused(lambda: parse_query("a={x"))),
        ("jobs", ",".join(f"{j.id}:{j.source_uri}" for j in jobs(env).values())),
        ("one place", refused(lambda: jobs(same))),
        ("position", str(cursor_value(cursor_text(moment, "timestamp_ntz"), "timestamp_ntz") == moment)),
    ]
    return rows(spark, out, "setting string, value string")


QUERIES["settings"] = settings
ORACLES["settings"] = (
    "SELECT * FROM (VALUES ('iso date', '2024-03-01 00:00:00'), ('merged', 'k,7,append,merge'), ('deep merge', '{''x'': {''y'': 1, ''z'': [2]}}'), ('bad date', 'refused'), ('bad step', 'refused'), ('ids', '(''a'', [''1'', ''2''])'), "
    "('query', '(''a'', {''x'': {''$gt'': 1}})'), ('bad query', 'refused'), ('jobs', 'a:/data/a'), ('one place', 'refused'), ('position', 'True')) t(setting, value)"
)


def text_and_lookups(spark, sf_dir):
    """One value through an operator, and what the registry offers for a kind of value."""
    texts = [("mask_email", None, "robert@example.com"), ("smart_mask", "US_SSN", "123-45-6789"), ("redact", None, "x"), ("hash", None, " "), ("mask", None, None)]
    out = [(f"{o}:{e}", anonymize_text(spark, t, o, e)) for o, e, t in texts]
    out += [(f"for {e}", ",".join(operators_for(e)[:2])) for e in ("PERSON", "CA_SIN", "URL")]
    return rows(spark, [*out, ("entities", str("IBAN_CODE" in supported_entities()))], "question string, answer string")


QUERIES["text_and_lookups"] = text_and_lookups
ORACLES["text_and_lookups"] = (
    "SELECT * FROM (VALUES ('mask_email:None', 'ro**rt@example.com'), ('smart_mask:US_SSN', '***-**-6789'), ('redact:None', ''), ('hash:None', ' '), ('mask:None', NULL), ('for PERSON', 'mask_person,fake_name'), "
    "('for CA_SIN', 'mask_sin,smart_mask'), ('for URL', 'smart_mask,smart_fake'), ('entities', 'True')) t(question, answer)"
)
