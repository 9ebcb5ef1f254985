"""Scans: sample collections, find personal values, cursors and relationships, and propose a configuration."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarnflow.operators.detect import RECOGNIZERS, Recognizer, best_entity, cursor_with_values, field_statistics, long_form, recommended
from tarnflow.operators.relationships import Relationship, infer_from_schemas
from tarnflow.operators.sampling import sample
from tarnflow.plans.config import CollectionConfig, Config, LoadConfig, RelationshipConfig, ScanConfig
from tarnflow.sources.catalog import FolderCatalog, discover


@dataclass
class CollectionScan:
    name: str
    total: int
    sampled: int
    strategy: str
    cursor: str | None
    findings: list[dict] = field(default_factory=list)


@dataclass
class ScanResult:
    collections: list[CollectionScan]
    excluded: list[str]
    relationships: list[Relationship]
    config: Config


def scan(spark: SparkSession, catalog: FolderCatalog, config: Config | None = None, seed: int = 0, recognizers: list[Recognizer] | None = None) -> ScanResult:
    """Scan the collections that the configuration takes, with the given recognizers or the built-in ones."""
    config = config or Config(scan=ScanConfig())
    s = config.scan or ScanConfig()
    found = discover(catalog.names(), not s.discovery.include_patterns, tuple(s.discovery.include_patterns), tuple(s.discovery.exclude_patterns))
    if lost := sorted(set(s.pii_analysis.entity_types) - {r.entity for r in recognizers or RECOGNIZERS}):
        warnings.warn(f"no recognizer finds {', '.join(lost)}: register one (names need a language model)", stacklevel=2)
    scans, schemas = [], {}
    for name in found.included:
        df = catalog.load(name)
        schemas[name] = df.schema
        part = sample(df, s.sampling.sample_size, s.sampling.sample_strategy, seed=seed)
        n = min(part.total, s.sampling.sample_size)
        one = CollectionScan(name, part.total, n, part.strategy, cursor_with_values(part.df, s.cursor_detection.cursor_fields))
        if s.pii_analysis.enabled and part.total:
            p = s.pii_analysis
            rows = long_form(part.df.withColumn("__doc", F.monotonically_increasing_id()), F.col("__doc"), tuple(p.allowlist))
            stats = field_statistics(best_entity(rows, p.entity_types if recognizers is None else None, p.confidence_threshold, recognizers), n, p.least_prevalence)
            stats = stats.withColumn("strategy", recommended(F.col("entity"), F.col("avg_confidence"), p.default_strategies))
            one.findings = [r.asDict() for r in stats.collect()]  # a row for each field and kind
        scans.append(one)
    inferred = infer_from_schemas(spark, schemas) if s.schema_relationships.enabled else []
    return ScanResult(scans, found.excluded, inferred, proposal(config, scans, inferred))


def proposal(config: Config, scans: list[CollectionScan], inferred: list[Relationship]) -> Config:
    """``config`` with what the scan adds; what it has already stays."""
    load = (config.replication or LoadConfig()).model_copy(deep=True)
    collections = dict(load.collections)
    for one in scans:
        pii = (config.scan or ScanConfig()).pii_analysis
        steps = [pii.step(f["path"], f["entity"], f["strategy"]) for f in sorted(one.findings, key=lambda f: (f["path"], -f["avg_confidence"])) if f["strategy"] != "keep"]
        own = collections.get(one.name)
        given = own.model_dump(exclude_unset=True) if own else {}
        have = {t.get("field") for t in given.get("transforms", []) if t["type"] == "anonymize"}
        new = [t for t in steps if t["field"] not in have]
        if new:
            given["transforms"] = [*given.get("transforms", []), *new]
        if one.cursor and not given.get("cursor_field"):
            given["cursor_field"] = one.cursor
        if given:
            collections[one.name] = CollectionConfig(**given)
    load.collections = collections
    known = {(r.parent, r.child) for r in config.schema_relationships}
    taken = {r.child for r in config.schema_relationships}
    extra = []
    for r in inferred:
        if (r.parent, r.child) not in known and r.child not in taken:
            taken.add(r.child)
            extra.append(RelationshipConfig(parent=r.parent, child=r.child, parent_field=r.parent_field, child_field=r.child_field))
    return Config(scan=config.scan or ScanConfig(), replication=load, schema_relationships=[*config.schema_relationships, *extra])


def report(result: ScanResult) -> str:
    """The scan as Markdown."""
    findings = [(s, f) for s in result.collections for f in s.findings]
    lines = ["# Scan report", "", f"- collections scanned: {len(result.collections)}", f"- collections excluded: {len(result.excluded)}", f"- fields with personal values: {len({(s.name, f['path']) for s, f in findings})}", ""]
    by_entity: dict[str, int] = {}
    for _, f in findings:
        by_entity[f["entity"]] = by_entity.get(f["entity"], 0) + 1
    if by_entity:
        lines += ["| entity | fields |", "| --- | --- |", *(f"| {e} | {n} |" for e, n in sorted(by_entity.items(), key=lambda x: (-x[1], x[0]))), ""]
    for s in sorted(result.collections, key=lambda s: (-len(s.findings), s.name)):
        lines += [f"## {s.name}", "", f"{s.sampled} of {s.total} rows ({s.strategy}); cursor: {s.cursor or 'none'}", ""]
        if s.findings:
            lines += ["| field | entity | prevalence | confidence | strategy |", "| --- | --- | --- | --- | --- |"]
            lines += [f"| {f['path']} | {f['entity']} | {f['prevalence_pct']:.1f} % | {f['avg_confidence']:.2f} | {f['strategy']} |" for f in s.findings]
            lines.append("")
    if result.relationships:
        lines += ["## Relationships", "", *(f"- {r.parent}.{r.parent_field} -> {r.child}.{r.child_field}" for r in result.relationships), ""]
    return "\n".join(lines)
