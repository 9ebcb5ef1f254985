"""Parent-child relationships between collections: the graph, its checks, and inference."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.operators.paths import all_paths


@dataclass(frozen=True)
class Relationship:
    parent: str
    child: str
    parent_field: str = "_id"
    child_field: str = ""

    def __post_init__(self):
        if not (self.parent and self.child and self.parent_field and self.child_field):
            raise ValueError("a relationship names two collections and two fields")
        if self.parent == self.child:
            raise ValueError(f"{self.parent} cannot be its own parent")


class RelationshipGraph:
    """Each collection has at most one parent."""

    def __init__(self, relationships: list[Relationship]):
        self.relationships = list(relationships)
        self.children: dict[str, list[Relationship]] = {}
        self.parent: dict[str, Relationship] = {}
        for r in self.relationships:
            if r.child in self.parent:
                raise ValueError(f"{r.child} has two parents: {self.parent[r.child].parent} and {r.parent}")
            self.parent[r.child] = r
            self.children.setdefault(r.parent, []).append(r)

    def descendants(self, root: str) -> list[str]:
        """The root and everything below it, level by level."""
        out, seen, queue = [], {root}, deque([root])
        while queue:
            out.append(name := queue.popleft())
            for r in self.children.get(name, []):
                if r.child not in seen:
                    seen.add(r.child)
                    queue.append(r.child)
        return out

    def has_cycles(self) -> bool:
        """With one parent each, a cycle is a walk upwards that returns."""
        for name in self.parent:
            up, seen = name, set()
            while up in self.parent and up not in seen:
                seen.add(up)
                up = self.parent[up].parent
            if up in seen:
                return True
        return False

    def missing(self, collections: list[str]) -> list[str]:
        """Collections that some relationship names and the catalog lacks."""
        have = set(collections)
        return sorted({n for r in self.relationships for n in (r.parent, r.child)} - have)

    def tree(self, root: str, above: tuple[str, ...] = ()) -> dict:
        if root in above:
            return {"name": root, "is_cycle": True, "children": []}
        below = [self.tree(r.child, (*above, root)) | {"via": r.child_field} for r in self.children.get(root, [])]
        return {"name": root, "is_cycle": False, "children": below}


def render_tree(tree: dict, counts: dict[str, int] | None = None) -> str:
    """A text tree, with row counts if given."""
    counts = counts or {}

    def lines(node: dict, prefix: str, last: bool, top: bool):
        note = f" ({counts[node['name']]:,} rows)" if node["name"] in counts else ""
        note += f" via {node['via']}" if "via" in node else ""
        note += " [cycle]" if node["is_cycle"] else ""
        yield (node["name"] if top else f"{prefix}{'└── ' if last else '├── '}{node['name']}") + note
        deeper = "" if top else prefix + ("    " if last else "│   ")
        for i, child in enumerate(node["children"]):
            yield from lines(child, deeper, i == len(node["children"]) - 1, False)

    return "\n".join(lines(tree, "", True, True))


#: Field names that never refer to another collection.
SKIPPED = ("_id", "id", "created_at", "updated_at", "createdAt", "updatedAt")


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def infer(fields: DataFrame, collections: DataFrame) -> DataFrame:
    """parent, child, parent_field, child_field from (collection, field, pos) and (name).

    A field's last part may end in ``_id``, ``_ids``, ``Id`` or ``Ids``; what stands before
    it names a collection as it is or in a plural. The first field (by ``pos``)
    and the first spelling that fit win for each pair of collections.
    """
    leaf = F.element_at(F.split("field", "\\."), -1)
    base = F.when(leaf.rlike("_ids?$"), F.regexp_replace(leaf, "_ids?$", "")).when(leaf.rlike("[a-z0-9]Ids?$"), snake(F.regexp_replace(leaf, "Ids?$", "")))
    named = fields.withColumn("leaf", leaf).where(~F.col("leaf").isin(*SKIPPED)).withColumn("base", base).where("base is not null and base <> ''")
    plural = F.when(F.col("base").rlike("y$"), F.concat(F.regexp_replace("base", "y$", ""), F.lit("ies")))
    spelt = named.select("collection", "field", "pos", F.posexplode(F.array("base", F.concat("base", F.lit("s")), plural)).alias("rank", "name")).where("name is not null")
    met = spelt.join(collections.select("name").distinct(), "name").where("name <> collection")
    # one parent a field, then one field a pair of collections
    per_field = met.withColumn("n", F.row_number().over(Window.partitionBy("collection", "field").orderBy("rank"))).where("n = 1")
    first = per_field.withColumn("n", F.row_number().over(Window.partitionBy("name", "collection").orderBy("pos", "field"))).where("n = 1")
    return first.select(F.col("name").alias("parent"), F.col("collection").alias("child"), F.lit("_id").alias("parent_field"), F.col("field").alias("child_field"))


def infer_from_schemas(spark: SparkSession, schemas: dict[str, T.StructType]) -> list[Relationship]:
    """Relationships that the field names of some schemas suggest."""
    rows = [(name, p, i) for name, schema in schemas.items() for i, p in enumerate(all_paths(schema, 2))]
    if not rows:
        return []
    fields = spark.createDataFrame(rows, "collection string, field string, pos int")
    names = spark.createDataFrame([(n,) for n in schemas], "name string")
    found = infer(fields, names).orderBy("child", "child_field").collect()  # a row for two collections at most
    return [Relationship(r.parent, r.child, r.parent_field, r.child_field) for r in found]
