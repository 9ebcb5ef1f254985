"""Loads: one plan a collection (scan, filter, transform, observe, write), collections side by side."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators.cascade import cascade
from tarnflow.operators.filters import comparable, compile_filter, incremental, resolve
from tarnflow.operators.relationships import RelationshipGraph
from tarnflow.operators.transforms import Pipeline
from tarnflow.plans.config import CollectionConfig, Config
from tarnflow.sources.catalog import FolderCatalog, check_apart, discover
from tarnflow.sources.indexes import replicate
from tarnflow.sources.sinks import write
from tarnflow.sources.state import StateStore, cursor_text

Progress = Callable[[str, str, dict], None]


@dataclass
class Outcome:
    collection: str
    status: str
    documents: int = 0
    seconds: float = 0.0
    statistics: dict = field(default_factory=dict)
    cursor: object = None
    error: str | None = None
    index_errors: list[str] = field(default_factory=list)


@dataclass
class RunResult:
    run_id: str | None
    outcomes: list[Outcome]

    @property
    def succeeded(self) -> int:
        return sum(o.status == "completed" for o in self.outcomes)

    @property
    def failed(self) -> list[str]:
        return sorted(o.collection for o in self.outcomes if o.status == "failed")

    @property
    def documents(self) -> int:
        return sum(o.documents for o in self.outcomes)


def usable_cursor(df: DataFrame, config: CollectionConfig) -> str:
    """The field that loads move along: the configured one if it has values, else the fallback."""
    if config.write_disposition == "replace":
        return ""
    if config.cursor_field:
        found = resolve(df.schema, config.cursor_field)
        if found and df.where(found[0].isNotNull()).limit(1).count():
            return config.cursor_field
    return config.cursor_fallback_field if resolve(df.schema, config.cursor_fallback_field) else ""


def selection(df: DataFrame, config: CollectionConfig, cursor: str, last) -> DataFrame:
    """The rows of this load: beyond the last position (or the initial one, if comparable), and matching."""
    found = resolve(df.schema, cursor) if cursor else None
    start = last if last is not None else config.cursor_initial_value
    if found is None or start is None or not comparable(found[1], start):
        return df.where(compile_filter(config.match, df.schema)) if config.match else df
    return df.where(incremental(df.schema, cursor, start, config.match))


class Runner:
    def __init__(self, spark: SparkSession, source: FolderCatalog, destination: FolderCatalog, config: Config, state: StateStore | None = None, progress: Progress | None = None):
        check_apart(source.root, destination.root)
        self.spark, self.source, self.destination = spark, source, destination
        self.config, self.settings = config, config.replication
        names = self.settings.state_management
        self.state = state or StateStore(spark, destination.root, names.runs_collection, names.state_collection)
        self.progress = progress or (lambda *_: None)

    def collections(self, only: list[str] | None = None) -> list[str]:
        d, s = self.settings.discovery, self.settings.state_management
        found = discover(self.source.names(), d.replicate_all, tuple(d.include_patterns), tuple(d.exclude_patterns), (s.runs_collection, s.state_collection), tuple(self.settings.collections))
        names = [n for n in found.included if self.settings.of(n).enabled]
        if only is None:
            return names
        if lost := sorted(set(only) - set(self.source.names())):
            raise ValueError(f"no such collection: {', '.join(lost)}")
        return [n for n in names if n in only]

    def run(self, only: list[str] | None = None, *, ids: tuple[str, list] | None = None, query: tuple[str, dict] | None = None, parallel: int | None = None, dry_run: bool = False) -> RunResult:
        """Load all chosen collections; with ids or a query, the rows that belong to a root's rows."""
        if ids and query or (ids or query) and only:
            raise ValueError("ids, query and a choice of collections exclude one another")
        frames: dict[str, DataFrame] = {}
        if ids or query:
            graph = RelationshipGraph(self.config.graph())
            if lost := graph.missing(self.source.names()):
                raise ValueError(f"no such collection: {', '.join(lost)}")
            root = (ids or query)[0]
            frames = cascade(graph, self.source.load, root, ids=ids[1] if ids else None, query=query[1] if query else None, key=self.settings.of(root).primary_key).frames
            names = list(frames)
        else:
            names = self.collections(only)
        if dry_run:
            return RunResult(None, [Outcome(n, "planned", (frames[n] if n in frames else self.planned(n)).count()) for n in names])
        run = self.state.create_run()
        outcomes: list[Outcome] = []
        try:
            with ThreadPoolExecutor(parallel or self.settings.performance.max_parallel_collections) as pool:
                jobs = [pool.submit(inheritable_thread_target(self.spark)(lambda n=n: self._one(run, n, frames.get(n)))) for n in names]
                for job in as_completed(jobs):
                    o = job.result()
                    outcomes.append(o)
                    self.progress(o.collection, o.status, {"documents": o.documents, "error": o.error})
        except BaseException as e:
            self.state.fail_run(run, str(e))
            raise
        outcomes.sort(key=lambda o: o.collection)
        result = RunResult(run, outcomes)
        n_failed = len(result.failed)
        lost = sum(o.statistics.get("documents_failed", 0) for o in outcomes)
        self.state.complete_run(
            run,
            {"processed": len(outcomes), "succeeded": result.succeeded, "failed": n_failed},
            {"processed": result.documents, "succeeded": result.documents - lost, "failed": lost},
            {o.collection: (o.error or "")[:200] for o in outcomes if o.status == "failed"},
        )
        return result

    def planned(self, name: str) -> DataFrame:
        """The rows that the next load would take."""
        df, config = self.source.load(name), self.settings.of(name)
        return selection(df, config, usable_cursor(df, config), self.state.last_cursor(name))

    def _one(self, run: str, name: str, rows: DataFrame | None) -> Outcome:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        began, key = time.time(), self.state.start_collection(run, name)
        try:
            o = self._load(name, rows)
            o.seconds = time.time() - began
            counts = {"processed": o.documents, "succeeded": o.documents - o.statistics.get("documents_failed", 0), "failed": o.statistics.get("documents_failed", 0)}
            ops = {k: (v["fields_configured"], v["fields_processed"]) for k, v in o.statistics.get("operations", {}).items()}
            done = (o.statistics.get("documents_processed", o.documents), o.statistics.get("transforms_applied", 0), ops)
            self.state.complete_collection(key, counts, o.cursor, done)
            return o
        except Exception as e:  # the other collections go on
            self.state.fail_collection(key, str(e))
            return Outcome(name, "failed", 0, time.time() - began, error=str(e)[:2000])

    def _load(self, name: str, rows: DataFrame | None) -> Outcome:
        config = self.settings.of(name)
        df = self.source.load(name)
        if rows is not None:  # rows of a cascade replace the collection, whatever the cursor
            cursor, chosen, disposition = "", rows, "replace"
            if config.match:
                chosen = chosen.where(compile_filter(config.match, chosen.schema))
        else:
            cursor = usable_cursor(df, config)
            chosen, disposition = selection(df, config, cursor, self.state.last_cursor(name)), config.write_disposition
        seen = Observation(f"load-{name}-{time.time_ns()}")
        position = resolve(df.schema, cursor) if cursor else None
        chosen = chosen.observe(seen, F.count(F.lit(1)).alias("n"), *([F.max(position[0]).alias("last")] if position else []))
        result = Pipeline(config.transforms, config.transform_error_mode).apply(chosen)
        # The rows are written once and counted on the way; merge and append read the written rows.
        path = f"{self.destination.root}/_staging-rows-{name}-{time.time_ns()}"
        try:
            result.df.write.parquet(path)
            staged = self.spark.read.schema(result.df.schema).parquet(path)
            statistics = result.statistics()
            got = seen.get
            if got["n"] or disposition == "replace" or not self.destination.has(name):
                write(staged, self.destination.path(name), disposition, config.primary_key, cursor or None, self.destination.format, self.destination.options)
        finally:
            from tarnflow.sources.catalog import filesystem

            fs, p = filesystem(self.spark, path)
            fs.delete(p, True)
        errors: list[str] = []
        if config.indexes:
            *_, errors = replicate(self.spark, self.destination.load(name), config.indexes)
        last = got.get("last") if position else None
        kind = position[1].simpleString() if position else None
        where = (cursor_text(last, kind), kind, cursor) if last is not None else None
        return Outcome(name, "completed", got["n"], statistics=statistics, cursor=where, index_errors=errors)


def parse_ids(option: str) -> tuple[str, list[str]]:
    """``collection=id1,id2``."""
    name, sep, rest = option.partition("=")
    ids = [i.strip() for i in rest.split(",") if i.strip()]
    if not sep or not name.strip() or not ids:
        raise ValueError("write ids as collection=id1,id2")
    return name.strip(), ids


def parse_query(option: str) -> tuple[str, dict]:
    """``collection={json}``."""
    name, sep, rest = option.partition("=")
    try:
        query = json.loads(rest) if sep else None
    except json.JSONDecodeError as e:
        raise ValueError(f"the query is no JSON: {e}") from e
    if not name.strip() or not isinstance(query, dict):
        raise ValueError('write a query as collection={"field": value}')
    return name.strip(), query
