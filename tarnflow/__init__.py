"""Document pipelines on Spark: filter, transform, anonymize, relate, profile and load collections."""

from importlib import import_module

#: What the package offers, by the module that has it; loaded when first asked for.
EXPORTS = {
    "Pipeline": "operators.transforms",
    "TransformError": "operators.transforms",
    "matched": "operators.filters",
    "compile_filter": "operators.filters",
    "incremental": "operators.filters",
    "cascade": "operators.cascade",
    "Relationship": "operators.relationships",
    "RelationshipGraph": "operators.relationships",
    "sample": "operators.sampling",
    "best_entity": "operators.detect",
    "load_recognizers": "operators.detect",
    "register_recognizer": "operators.detect",
    "register": "operators.anonymize",
    "Config": "plans.config",
    "load_config": "plans.config",
    "Runner": "plans.runner",
    "scan": "plans.scan",
    "report": "plans.scan",
    "FolderCatalog": "sources.catalog",
    "TableCatalog": "sources.catalog",
    "StateStore": "sources.state",
    "get_job": "sources.jobs",
    "write": "sources.sinks",
    "load_stream": "streaming.incremental",
}
__all__ = sorted(EXPORTS)


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{EXPORTS[name]}"), name)
