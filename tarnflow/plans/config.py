"""Configuration: scan, load and relationships, validated, merged over defaults, saved without loss."""

from __future__ import annotations

import datetime as dt
import os
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

from tarnflow.operators.anonymize import operator
from tarnflow.operators.relationships import Relationship
from tarnflow.operators.transforms import checked


class Part(BaseModel):
    model_config = ConfigDict(extra="forbid", validate_assignment=True)


class DiscoveryConfig(Part):
    replicate_all: bool = True
    include_patterns: list[str] = Field(default_factory=list)
    exclude_patterns: list[str] = Field(default_factory=list)


class SamplingConfig(Part):
    sample_size: int = Field(1000, ge=1)
    sample_strategy: Literal["random", "stratified"] = "stratified"


#: What a scan looks for, and the strategies it proposes.
ENTITIES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "PERSON", "US_SSN", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "URL"]
STRATEGIES = {
    "EMAIL_ADDRESS": "smart_mask", "PHONE_NUMBER": "smart_mask", "PERSON": "smart_mask", "US_SSN": "smart_mask", "CREDIT_CARD": "smart_mask", "IBAN_CODE": "smart_mask",
    "IP_ADDRESS": "smart_mask", "URL": "keep", "LOCATION": "smart_mask", "US_BANK_ACCOUNT": "smart_mask", "CA_BANK_ACCOUNT": "smart_mask",
}
CURSOR_FIELDS = ["updated_at", "updatedAt", "meta.updated_at", "meta.updatedAt"]


class PiiConfig(Part):
    enabled: bool = True
    confidence_threshold: float = Field(0.85, ge=0, le=1)
    least_prevalence: float = Field(0.10, ge=0, le=1)
    entity_types: list[str] = Field(default_factory=lambda: list(ENTITIES))
    default_strategies: dict[str, str] = Field(default_factory=lambda: dict(STRATEGIES))
    allowlist: list[str] = Field(default_factory=list)
    #: Operators by entity with their parameters, before the strategies above.
    anonymization_operators: dict[str, dict[str, Any]] = Field(default_factory=dict)
    #: Other names for operators, as strategies.
    custom_strategy_aliases: dict[str, str] = Field(default_factory=dict)

    @model_validator(mode="after")
    def known(self):
        for spec in self.anonymization_operators.values():
            operator(self.custom_strategy_aliases.get(spec["operator"], spec["operator"]), spec.get("params"))
        return self

    def step(self, path: str, entity: str, strategy: str) -> dict[str, Any]:
        """The anonymization step that a finding asks for."""
        spec = self.anonymization_operators.get(entity, {"operator": strategy})
        name = self.custom_strategy_aliases.get(spec["operator"], spec["operator"])
        return {"type": "anonymize", "field": path, "operator": name, "params": {**(spec.get("params") or {}), "entity_type": entity}}


class CursorConfig(Part):
    cursor_fields: list[str] = Field(default_factory=lambda: list(CURSOR_FIELDS))


class InferenceConfig(Part):
    enabled: bool = False


class ScanConfig(Part):
    discovery: DiscoveryConfig = Field(default_factory=DiscoveryConfig)
    sampling: SamplingConfig = Field(default_factory=SamplingConfig)
    pii_analysis: PiiConfig = Field(default_factory=PiiConfig)
    cursor_detection: CursorConfig = Field(default_factory=CursorConfig)
    schema_relationships: InferenceConfig = Field(default_factory=InferenceConfig)


class Defaults(Part):
    cursor_field: str | None = None
    cursor_fallback_field: str = "_id"
    cursor_initial_value: dt.datetime | None = dt.datetime(2020, 1, 1)
    primary_key: str = "_id"
    write_disposition: Literal["merge", "append", "replace"] = "merge"
    transform_error_mode: Literal["skip", "fail"] = "skip"

    @field_validator("cursor_initial_value", mode="before")
    @classmethod
    def iso(cls, v):
        """Dates as ISO 8601 text become datetimes in UTC without a zone."""
        if isinstance(v, str):
            try:
                v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
            except ValueError as e:
                raise ValueError(f"cursor_initial_value is no ISO 8601 date: {v!r}") from e
        if isinstance(v, dt.datetime) and v.tzinfo:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        if v is not None and not isinstance(v, dt.datetime):
            raise ValueError("cursor_initial_value must be a date")
        return v


class CollectionConfig(Defaults):
    enabled: bool = True
    batch_size: int | None = Field(None, ge=1)
    match: dict[str, Any] | None = None
    transforms: list[dict[str, Any]] = Field(default_factory=list)
    indexes: list[dict[str, Any]] = Field(default_factory=list)

    @field_validator("transforms")
    @classmethod
    def steps(cls, v):
        return [checked(s) for s in v]


class StateConfig(Part):
    runs_collection: str = "_rep_runs"
    state_collection: str = "_rep_state"


class PerformanceConfig(Part):
    max_parallel_collections: int = Field(5, ge=1)
    batch_size: int = Field(1000, ge=1)  # kept for configurations that have it; plans have no batches


class LoadConfig(Part):
    discovery: DiscoveryConfig = Field(default_factory=DiscoveryConfig)
    state_management: StateConfig = Field(default_factory=StateConfig)
    performance: PerformanceConfig = Field(default_factory=PerformanceConfig)
    defaults: Defaults = Field(default_factory=Defaults)
    collections: dict[str, CollectionConfig] = Field(default_factory=dict)

    def of(self, name: str) -> CollectionConfig:
        """A collection's settings: the defaults, with what it sets itself."""
        own = self.collections.get(name)
        given = own.model_dump(exclude_unset=True) if own else {}
        return CollectionConfig(**(self.defaults.model_dump() | given))


class RelationshipConfig(Part):
    parent: str
    child: str
    parent_field: str = "_id"
    child_field: str

    @model_validator(mode="after")
    def sound(self):
        self.relationship()
        return self

    def relationship(self) -> Relationship:
        return Relationship(self.parent, self.child, self.parent_field, self.child_field)


class Config(Part):
    scan: ScanConfig | None = None
    replication: LoadConfig | None = None
    schema_relationships: list[RelationshipConfig] = Field(default_factory=list)

    @model_validator(mode="after")
    def something(self):
        if self.scan is None and self.replication is None:
            raise ValueError("a configuration has a scan or a replication section")
        return self

    def graph(self) -> list[Relationship]:
        return [r.relationship() for r in self.schema_relationships]


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` upon ``base``: documents merge by key, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | None = None, text: str | None = None, defaults: dict | None = None) -> Config:
    """A configuration from YAML, over ``defaults``."""
    if text is None:
        if not path or not os.path.exists(path):
            raise FileNotFoundError(f"no configuration at {path}")
        with open(path, encoding="utf-8") as f:
            text = f.read()
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("a configuration is a document")
    return Config.model_validate(deep_merge(defaults or {}, data))


def dump_config(config: Config) -> str:
    """YAML that loads to an equal configuration; only what was set."""
    return yaml.safe_dump(config.model_dump(exclude_unset=True, mode="json"), sort_keys=False, allow_unicode=True)


def save_config(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(dump_config(config))


def starter(source: str, destination: str) -> str:
    """A first configuration, as YAML with comments."""
    return f"# from {source}\n# to {destination}\n" + dump_config(Config(scan=ScanConfig(discovery=DiscoveryConfig()), replication=LoadConfig(defaults=Defaults(write_disposition="merge"))))
