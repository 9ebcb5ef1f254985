"""Queries of cascades, relationships, write dispositions, sampling, discovery and state."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tarnflow.operators.cascade import cascade, orphans
from tarnflow.operators.detect import cursor_field
from tarnflow.operators.paths import matches, normalize, wildcard_regex
from tarnflow.operators.relationships import Relationship, RelationshipGraph, infer
from tarnflow.operators.sampling import newest_and_oldest, sample
from tarnflow.operators.transforms import Pipeline
from tarnflow.plans.samples import table
from tarnflow.sources.catalog import selected
from tarnflow.sources.indexes import Index, unexpired, violations
from tarnflow.sources.sinks import duplicates, merged, summarize_errors, write
from tarnflow.sources.state import last_cursor, latest_by, merge_operations, roll_up
from tarnflow.streaming.incremental import load_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

GRAPH = RelationshipGraph([
    Relationship("region", "nation", "r_regionkey", "n_regionkey"),
    Relationship("nation", "customer", "n_nationkey", "c_nationkey"),
    Relationship("customer", "orders", "c_custkey", "o_custkey"),
    Relationship("orders", "lineitem", "o_orderkey", "l_orderkey"),
])


def walk(spark, sf_dir, root, **how):
    return cascade(GRAPH, lambda n: table(spark, sf_dir, n), root, **how)


def cascade_ids(spark, sf_dir):
    return walk(spark, sf_dir, "customer", ids=["3", 17, "42", "9999999"], key="c_custkey").frames["lineitem"].select("l_orderkey", "l_linenumber")


def cascade_query(spark, sf_dir):
    return walk(spark, sf_dir, "customer", query={"c_mktsegment": "BUILDING"}).frames["orders"].select("o_orderkey", "o_custkey")


def cascade_counts(spark, sf_dir):
    c = walk(spark, sf_dir, "region", query={"r_name": {"$in": ["ASIA", "EUROPE"]}})
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("collection"), "n") for n, df in c.frames.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def cascade_skipped(spark, sf_dir):
    c = walk(spark, sf_dir, "customer", query={"c_custkey": -1})
    return spark.createDataFrame([(n,) for n in c.skipped()], "collection string")


B = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"
QUERIES |= {"cascade_ids": cascade_ids, "cascade_query": cascade_query, "cascade_counts": cascade_counts, "cascade_children_skipped": cascade_skipped}
ORACLES["cascade_ids"] = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 17, 42))"
ORACLES["cascade_query"] = f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ({B})"
_R = "SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')"
_N = f"SELECT n_nationkey FROM nation WHERE n_regionkey IN ({_R})"
_C = f"SELECT c_custkey FROM customer WHERE c_nationkey IN ({_N})"
_O = f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({_C})"
ORACLES["cascade_counts"] = f"SELECT 'region' AS collection, count(*) AS n FROM ({_R}) UNION ALL SELECT 'nation', count(*) FROM ({_N}) UNION ALL SELECT 'customer', count(*) FROM ({_C}) UNION ALL SELECT 'orders', count(*) FROM ({_O}) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN ({_O})"
ORACLES["cascade_children_skipped"] = "SELECT unnest(['orders', 'lineitem']) AS collection"
QUERIES["orphans"] = lambda spark, d: orphans(table(spark, d, "customer").where("c_custkey % 3 <> 0"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("o_orderkey", "o_custkey")
ORACLES["orphans"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"


def flagship(spark, sf_dir):
    """Customers of one segment, masked, with the orders and lines that belong to them."""
    frames = walk(spark, sf_dir, "customer", query={"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 0}}).frames
    buyers = Pipeline([{"type": "anonymize", "field": "c_name", "operator": "mask_person"}]).apply(frames["customer"].select("c_custkey", "c_name")).df
    lines = frames["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    per = frames["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return buyers.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = (
    "SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS c_name, coalesce(n, 0) AS orders, coalesce(l, 0)::BIGINT AS lines FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(k) AS l FROM orders LEFT JOIN "
    "(SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0"
)

# -- write dispositions, through tables in a scratch folder


def scratch(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root}/{spark.sparkContext.applicationId}/sink-{dt.datetime.now().timestamp()}" if root else tempfile.mkdtemp(prefix="tarnflow-sink-")


def halves(spark, sf_dir):
    """An old version of some orders, and a load that overlaps it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    old = o.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.lit(0.0))
    new = o.where("o_orderkey % 2 = 0")
    return old, new.unionByName(new.where("o_orderkey % 4 = 0").withColumn("o_orderdate", F.col("o_orderdate") - F.expr("interval 1 day")).withColumn("o_totalprice", F.lit(-1.0)))


def merge_upsert(spark, sf_dir):
    """Merging twice is merging once; of rows with one key the one with the latest cursor stays."""
    old, new = halves(spark, sf_dir)
    path = scratch(spark) + "/t"
    write(old, path, "replace", "o_orderkey")
    for _ in range(2):
        write(new, path, "merge", "o_orderkey", "o_orderdate")
    return spark.read.parquet(path)


MERGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0"
QUERIES["merge_upsert"], ORACLES["merge_upsert"] = merge_upsert, MERGED
QUERIES["merge_plan"] = lambda spark, d: merged(*halves(spark, d), "o_orderkey", "o_orderdate")
ORACLES["merge_plan"] = MERGED


def append_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = scratch(spark) + "/t"
    write(o.where("o_orderkey % 2 = 0"), path, "append", "o_orderkey")
    write(o.where("o_orderkey % 2 = 1"), path, "append", "o_orderkey")
    return spark.read.parquet(path)


QUERIES["append_new"], ORACLES["append_new"] = append_new, "SELECT o_orderkey, o_totalprice FROM orders"
QUERIES["append_dup_check"] = lambda spark, d: duplicates(*halves(spark, d), "o_orderkey")
ORACLES["append_dup_check"] = "SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END + CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 3 <> 0)"


def replace_full(spark, sf_dir):
    """A table is replaced by rows that are read from itself."""
    path = scratch(spark) + "/t"
    write(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path, "replace")
    write(spark.read.parquet(path).where("o_orderkey % 5 = 0"), path, "replace")
    return spark.read.parquet(path)


QUERIES["replace_full"], ORACLES["replace_full"] = replace_full, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0"


def incremental_available_now(spark, sf_dir):
    """Two streaming loads; the second takes only the new file, and merges."""
    root = scratch(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    how = {"key": "o_orderkey", "match": {"o_orderstatus": {"$ne": "P"}}, "transforms": [{"type": "anonymize", "field": "o_orderstatus", "operator": "replace", "params": {"new_value": "S"}}]}
    o.where("o_orderkey % 3 <> 0").coalesce(1).write.parquet(f"{root}/in")
    load_stream(spark, f"{root}/in", o.schema, f"{root}/out", f"{root}/at", **how)
    o.where("o_orderkey % 3 <> 1").withColumn("o_totalprice", F.lit(1.0)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    load_stream(spark, f"{root}/in", o.schema, f"{root}/out", f"{root}/at", **how)
    return spark.read.parquet(f"{root}/out")


QUERIES["incremental_available_now"] = incremental_available_now
ORACLES["incremental_available_now"] = "SELECT o_orderkey, 'S' AS o_orderstatus, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE 1.0 END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'"

# -- sampling

QUERIES["sample_all"] = lambda spark, d: sample(table(spark, d, "nation"), 1000).df
ORACLES["sample_all"] = "SELECT * FROM nation"
QUERIES["sample_stratified"] = lambda spark, d: newest_and_oldest(table(spark, d, "events"), "ts", 101).select("event_id", "ts")
ORACLES["sample_stratified"] = "(SELECT event_id, ts FROM events ORDER BY ts DESC LIMIT 50) UNION ALL (SELECT event_id, ts FROM events ORDER BY ts LIMIT 50)"
QUERIES["sample_random"] = lambda spark, d: sample(table(spark, d, "events"), 100, "random").df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("d"))
ORACLES["sample_random"] = "SELECT 100::BIGINT AS n, 100::BIGINT AS d"

# -- discovery and paths

NAMES = ["users", "orders", "order_items", "tmp_users", "_rep_runs", "archive_2020"]


def names_of(spark, **how):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return df.where(selected(F.col("name"), **how))


QUERIES["discover_include"] = lambda spark, d: names_of(spark, replicate_all=False, include=("^order", "users$"), exclude=("^tmp",), internal=("_rep_runs",))
ORACLES["discover_include"] = "SELECT unnest(['users', 'orders', 'order_items']) AS name"
QUERIES["discover_exclude"] = lambda spark, d: names_of(spark, exclude=("[0-9]{4}$",), internal=("_rep_runs",))
ORACLES["discover_exclude"] = "SELECT unnest(['users', 'orders', 'order_items', 'tmp_users']) AS name"
PATHS = [("user.profile.email", "user.*.email"), ("user.email", "user.*.email"), ("email", "*.email"), ("user.emailAddress", "*.email"), ("_id", "*"), ("a.b", "a.b"), ("a.bc", "a.b")]


def wildcard_match(spark, sf_dir):
    rows = [(p, w, wildcard_regex(w), matches(p, w)) for p, w in PATHS]
    return spark.createDataFrame(rows, "path string, pattern string, regex string, driver boolean").select("path", "pattern", F.expr("path rlike regex").alias("hit"), "driver")


QUERIES["wildcard_match"] = wildcard_match
ORACLES["wildcard_match"] = "SELECT path, pattern, hit, hit AS driver FROM (VALUES ('user.profile.email', 'user.*.email', true), ('user.email', 'user.*.email', false), ('email', '*.email', false), ('user.emailAddress', '*.email', true), ('_id', '*', true), ('a.b', 'a.b', true), ('a.bc', 'a.b', false)) t(path, pattern, hit)"
QUERIES["normalize_path"] = lambda spark, d: spark.createDataFrame([(p,) for p in ("users[2].forms[1].sinNumber", "[0]", "a.b", "tags[3]")], "path string").select("path", normalize(F.col("path")).alias("plain"))
ORACLES["normalize_path"] = "SELECT * FROM (VALUES ('users[2].forms[1].sinNumber', 'users.forms.sinNumber'), ('[0]', ''), ('a.b', 'a.b'), ('tags[3]', 'tags')) t(path, plain)"


def cursor_detection(spark, sf_dir):
    from pyspark.sql import types as T

    plain = lambda *n: T.StructType([T.StructField(x, T.TimestampType()) for x in n])
    nested = lambda a, b: T.StructType([T.StructField(a, plain(b))])
    schemas = {"plain": plain("updated_at"), "upper": plain("UPDATEDAT"), "nested": nested("META", "UpdatedAt"), "none": plain("other"), "both": plain("updatedAt", "updated_at")}
    names = ["updated_at", "updatedAt", "meta.updated_at", "meta.updatedAt"]
    return spark.createDataFrame([(n, cursor_field(s, names)) for n, s in schemas.items()], "name string, cursor string")


QUERIES["detect_cursor"] = cursor_detection
ORACLES["detect_cursor"] = "SELECT * FROM (VALUES ('plain', 'updated_at'), ('upper', 'updatedAt'), ('nested', 'meta.updatedAt'), ('none', NULL), ('both', 'updated_at')) t(name, cursor)"
FIELDS = [
    ("orders", "_id", 0), ("orders", "customer_id", 1), ("orders", "meta.customerId", 2), ("orders", "created_at", 3), ("order_items", "order_id", 0), ("order_items", "productIds", 1), ("products", "category_id", 0),
    ("products", "product_id", 1), ("projects", "details.organization_id", 0), ("projects", "ownerId", 1),
]


def infer_relationships(spark, sf_dir):
    fields = spark.createDataFrame(FIELDS, "collection string, field string, pos int")
    names = spark.createDataFrame([(n,) for n in ("customers", "orders", "order_items", "products", "categories", "organizations", "projects")], "name string")
    return infer(fields, names)


QUERIES["infer_relationships"] = infer_relationships
ORACLES["infer_relationships"] = "SELECT *, '_id' AS parent_field FROM (VALUES ('customers', 'orders', 'customer_id'), ('orders', 'order_items', 'order_id'), ('products', 'order_items', 'productIds'), ('categories', 'products', 'category_id'), ('organizations', 'projects', 'details.organization_id')) t(parent, child, child_field)"

# -- indexes

QUERIES["index_unique_check"] = lambda spark, d: violations(table(spark, d, "customer"), Index.of({"name": "u", "key": {"c_nationkey": 1, "c_mktsegment": 1}, "unique": True, "partialFilterExpression": {"c_acctbal": {"$gt": 9000}}})).withColumnsRenamed({"k0": "nation", "k1": "segment"})
ORACLES["index_unique_check"] = "SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY ALL HAVING count(*) > 1"
QUERIES["index_ttl"] = lambda spark, d: unexpired(table(spark, d, "orders"), Index.of({"name": "t", "key": {"o_orderdate": 1}, "expireAfterSeconds": 86400}), dt.datetime(1997, 1, 1)).select("o_orderkey")
ORACLES["index_ttl"] = "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 1 DAY > TIMESTAMP '1997-01-01'"

# -- state, over rows derived from orders


def state_rows(spark, sf_dir):
    """One row an order, read as the load of a collection."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("collection"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "O", F.lit("failed")).otherwise(F.lit("running")).alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("lastCursorValue"),
        (F.to_timestamp(F.lit("2020-01-01")) + F.make_dt_interval(secs=F.col("o_orderkey").cast("double"))).alias("endedAt"),
        F.col("o_orderkey").alias("seq"),
    )


_STATE = "(SELECT 'c' || (o_custkey % 20) AS collection, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS lastCursorValue, o_orderkey AS seq FROM orders)"
QUERIES["last_cursor"] = lambda spark, d: last_cursor(state_rows(spark, d))
ORACLES["last_cursor"] = f"SELECT collection, arg_max(lastCursorValue, seq) AS last_cursor FROM {_STATE} WHERE status = 'completed' AND lastCursorValue IS NOT NULL GROUP BY 1"
QUERIES["latest_state"] = lambda spark, d: latest_by(state_rows(spark, d), "collection").select("collection", "status", "seq")
ORACLES["latest_state"] = f"SELECT collection, arg_max(status, seq) AS status, max(seq) AS seq FROM {_STATE} GROUP BY 1"


def run_rollup(spark, sf_dir):
    rows = latest_by(state_rows(spark, sf_dir), "collection").select("collection", "status", (F.col("seq") % 100).alias("docs"), F.concat(F.lit("failed "), F.col("collection")).alias("error"))
    return roll_up(rows).select("processed", "succeeded", "failed", "documents", F.array_join(F.array_sort(F.map_values("errors")), ";").alias("errors"))


QUERIES["run_rollup"] = run_rollup
ORACLES["run_rollup"] = (
    f"SELECT count(*) AS processed, count(*) FILTER (status = 'completed') AS succeeded, count(*) FILTER (status = 'failed') AS failed, sum(seq % 100)::BIGINT AS documents, "
    f"coalesce(string_agg('failed ' || collection, ';' ORDER BY 'failed ' || collection) FILTER (status = 'failed'), '') AS errors FROM (SELECT collection, arg_max(status, seq) AS status, max(seq) AS seq FROM {_STATE} GROUP BY 1)"
)


def op_stats_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("fields_configured"), F.col("l_quantity").cast("bigint").alias("fields_processed"), F.col("l_suppkey").alias("duration"))
    return merge_operations(rows)


QUERIES["op_stats_rollup"] = op_stats_rollup
ORACLES["op_stats_rollup"] = "SELECT l_returnflag AS type, max(l_linenumber) AS fields_configured, sum(l_quantity::BIGINT)::BIGINT AS fields_processed, sum(l_suppkey)::BIGINT AS duration FROM lineitem GROUP BY 1"


def error_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(11000)).otherwise(F.lit(121)).alias("code"),
        F.concat(F.lit("E11000 dup key: { _id: "), F.col("o_orderkey").cast("string"), F.lit(" } "), F.repeat(F.lit("x"), F.lit(300)), F.lit("\nmore")).alias("message"),
        F.col("o_orderkey").alias("pos"),
    )
    return summarize_errors(rows)


QUERIES["error_summary"] = error_summary
ORACLES["error_summary"] = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 11000 ELSE 121 END AS code, count(*) AS n, left('E11000 dup key: { ... } ' || repeat('x', 300), 200) AS message FROM orders GROUP BY 1"
