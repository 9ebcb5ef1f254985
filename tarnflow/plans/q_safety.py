"""Queries of what must not go wrong: nothing passes in the clear, no error is lost, no version is arbitrary."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnflow.operators.cascade import related
from tarnflow.operators.filters import matched
from tarnflow.operators.transforms import Pipeline, TransformError
from tarnflow.plans.samples import people, people_sql, table
from tarnflow.sources.sinks import merged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def redacted(v: str, to: str = "''") -> str:
    return f"CASE WHEN {v} IS NULL OR regexp_full_match({v}, '\\s*') THEN {v} ELSE {to} END"


def anonymize_struct(spark, sf_dir):
    """A field that is a document: every value in it, at any depth."""
    df = people(spark, sf_dir, "person", "email", "phone", "nick")
    user = F.struct("person", F.struct("email", F.array("phone", "nick").alias("others")).alias("contact"))
    out = Pipeline([{"type": "anonymize", "field": "user", "operator": "redact"}]).apply(df.select("c_custkey", user.alias("user"))).df
    return out.select("c_custkey", "user.person", "user.contact.email", *(F.col("user.contact.others")[i].alias(n) for i, n in enumerate(("phone", "nick"))))


QUERIES["anonymize_struct"] = anonymize_struct
ORACLES["anonymize_struct"] = f"SELECT c_custkey, {', '.join(f'{redacted(v)} AS {v}' for v in ('person', 'email', 'phone', 'nick'))} FROM {people_sql('person', 'email', 'phone', 'nick')}"


def anonymize_struct_condition(spark, sf_dir):
    df = people(spark, sf_dir, "person", "score", "nick").select("c_custkey", "nick", F.struct("person", "score").alias("user"))
    step = {"type": "anonymize", "field": "user", "operator": "replace", "params": {"new_value": "X"}, "condition": {"field": "nick", "operator": "$exists", "value": True}}
    return Pipeline([step]).apply(df).df.select("c_custkey", "user.person", "user.score")


QUERIES["anonymize_struct_condition"] = anonymize_struct_condition
ORACLES["anonymize_struct_condition"] = (
    f"SELECT c_custkey, CASE WHEN nick IS NULL THEN person ELSE {redacted('person', repr('X'))} END AS person, CASE WHEN score IS NULL THEN NULL WHEN nick IS NULL THEN CAST(score AS VARCHAR) ELSE 'X' END AS score FROM {people_sql('person', 'score', 'nick')}"
)


def anonymize_map(spark, sf_dir):
    """A map: all of its values, one entry by its key, or all by a pattern."""
    df = people(spark, sf_dir, "email", "phone")
    entries = F.create_map(F.lit("email"), F.col("email"), F.lit("phone"), F.col("phone"))
    df = df.select("c_custkey", *(entries.alias(n) for n in ("whole", "entry", "pattern")))
    fields = ("whole", "entry.email", "pattern.*")
    out = Pipeline([{"type": "anonymize", "field": f, "operator": "replace", "params": {"new_value": "X"}} for f in fields]).apply(df).df
    return out.select("c_custkey", *(F.col(m)[k].alias(f"{m}_{k}") for m in ("whole", "entry", "pattern") for k in ("email", "phone")))


QUERIES["anonymize_map"] = anonymize_map
ORACLES["anonymize_map"] = (
    "SELECT c_custkey, "
    + ", ".join(f"{v if (m, v) == ('entry', 'phone') else redacted(v, repr('X'))} AS {m}_{v}" for m in ("whole", "entry", "pattern") for v in ("email", "phone"))
    + f" FROM {people_sql('email', 'phone')}"
)


def raised(run) -> bool:
    try:
        run()
    except (TransformError, PySparkException):
        return True
    return False


def anonymize_absent(spark, sf_dir):
    """A field that no document has is an error; where the step calls it optional, it counts as nothing."""
    df = people(spark, sf_dir, "person").select("c_custkey", F.struct("person").alias("user"))
    rows = []
    for path in ("user.preson", "usr", "user.*.mail", "user.person"):
        step = {"type": "anonymize", "field": path, "operator": "redact"}
        result = Pipeline([{**step, "optional": True}]).apply(df)
        result.df.count()
        rows.append((path, raised(lambda step=step: Pipeline([step]).apply(df)), result.statistics()["transforms_applied"]))
    return spark.createDataFrame(rows, "path string, refused boolean, applied bigint")


QUERIES["anonymize_absent"] = anonymize_absent
ORACLES["anonymize_absent"] = "SELECT * FROM (VALUES ('user.preson', true, 0::BIGINT), ('usr', true, 0), ('user.*.mail', true, 0)) t(path, refused, applied) UNION ALL SELECT 'user.person', false, count(*) FROM customer"


def fail_pruned(spark, sf_dir):
    """In fail mode the query raises whatever it reads; without a conflict it does not."""
    df = people(spark, sf_dir, "nick", "score", "person")
    rows = []
    for field, reads in (("nick", "person"), ("nick", "nick"), ("fresh", "person")):
        out = Pipeline([{"type": "add_field", "field": field, "value": "v"}], "fail").apply(df).df.select(reads)
        rows += [(field, reads, "rows", raised(out.collect)), (field, reads, "count", raised(out.count))]
    return spark.createDataFrame(rows, "field string, reads string, action string, raised boolean")


QUERIES["fail_pruned"] = fail_pruned
ORACLES["fail_pruned"] = "SELECT field, reads, action, field = 'nick' AS raised FROM (VALUES ('nick', 'person'), ('nick', 'nick'), ('fresh', 'person')) t(field, reads), (VALUES ('rows'), ('count')) a(action)"


def merge_nested_cursor(spark, sf_dir):
    """Of many versions of a key the one with the greatest nested cursor stays."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_shipdate").alias("updatedAt")).alias("meta"))
    old = lines.where("l_orderkey % 2 = 0").limit(0)
    return merged(old, lines, "l_orderkey", "meta.updatedAt").select("l_orderkey", F.col("meta.updatedAt").alias("updated"))


QUERIES["merge_nested_cursor"] = merge_nested_cursor
ORACLES["merge_nested_cursor"] = "SELECT l_orderkey, max(l_shipdate) AS updated FROM lineitem GROUP BY 1"


def items(spark, sf_dir):
    item = F.struct(F.struct(F.col("l_suppkey").alias("supplier")).alias("ref"), F.col("l_quantity").alias("qty"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))


def match_elem_dotted(spark, sf_dir):
    return matched(items(spark, sf_dir), {"items": {"$elemMatch": {"ref.supplier": {"$lte": 3}, "qty": {"$gte": 30}}}}).select("l_orderkey")


QUERIES["match_elem_dotted"] = match_elem_dotted
ORACLES["match_elem_dotted"] = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey <= 3 AND l_quantity >= 30"


def cascade_array_refs(spark, sf_dir):
    """Rows that refer to their parents by an array, met by equal keys."""
    orders = table(spark, sf_dir, "orders")
    child = orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("refs"))
    return related(orders.where("o_totalprice > 300000"), child, "o_orderkey", "refs").select("o_custkey", F.size("refs").cast("bigint").alias("n"))


QUERIES["cascade_array_refs"] = cascade_array_refs
ORACLES["cascade_array_refs"] = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice > 300000) > 0"
