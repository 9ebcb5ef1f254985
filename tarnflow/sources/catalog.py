"""Collections by name: a folder of tables, or a catalog database; and which of them to take."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


class FolderCatalog:
    """``<root>/<name>.<format>`` or ``<root>/<name>`` for each collection, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, format: str = "parquet", **options):
        if format not in FORMATS:
            raise ValueError(f"format must be one of {', '.join(FORMATS)}")
        self.spark, self.root, self.format, self.options = spark, root.rstrip("/"), format, options

    def names(self) -> list[str]:
        fs, p = filesystem(self.spark, self.root)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        suffix = f".{self.format}"
        return sorted({n.removesuffix(suffix) for n in found if not n.startswith((".", "_staging", "_old")) and (n.endswith(suffix) or "." not in n)})

    def path(self, name: str) -> str:
        with_suffix = f"{self.root}/{name}.{self.format}"
        return with_suffix if exists(self.spark, with_suffix) else f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, self.path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.format(self.format).options(**self.options).load(self.path(name))


class TableCatalog:
    """The tables of a database of Spark's catalog."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        self.root = database

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def has(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")


def location(uri: str) -> str:
    """A path in one spelling: no scheme for local files, no trailing or doubled slash, lower-case authority."""
    m = re.match(r"^([a-z][a-z0-9+.-]*):(?://([^/]*))?(.*)$", uri.strip(), re.I)
    scheme, host, path = (m[1].lower(), (m[2] or "").lower(), m[3]) if m else ("file", "", uri.strip())
    path = re.sub(r"/+", "/", path).rstrip("/") or "/"
    return f"{scheme}://{host}{path}"


def check_apart(source: str, destination: str) -> None:
    """ValueError if both name one place."""
    if location(source) == location(destination):
        raise ValueError("source and destination must differ")


@dataclass(frozen=True)
class Discovery:
    included: list[str]
    excluded: list[str]
    configured: list[str]
    auto_discovered: list[str]


def selected(name: Column, replicate_all: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), internal: tuple[str, ...] = ()) -> Column:
    """Whether a collection is taken: patterns are searched for, exclusion wins, internal tables never."""
    hit = F.lit(replicate_all)
    for p in () if replicate_all else include:
        hit = hit | name.rlike(p)
    for p in (*exclude, *(f"^\\Q{t}\\E$" for t in internal)):
        hit = hit & ~name.rlike(p)
    return hit


def discover(names: list[str], replicate_all: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), internal: tuple[str, ...] = (), configured: tuple[str, ...] = ()) -> Discovery:
    """The same choice over a list of names, told apart by whether they have a configuration."""
    out = [re.compile(p) for p in exclude]
    into = [re.compile(p) for p in include]

    def take(n: str) -> bool:
        if n in internal or any(p.search(n) for p in out):
            return False
        return replicate_all or any(p.search(n) for p in into)

    included = sorted(n for n in names if take(n))
    return Discovery(included, sorted(set(names) - set(included)), [n for n in included if n in configured], [n for n in included if n not in configured])
