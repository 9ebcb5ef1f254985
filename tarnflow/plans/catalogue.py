"""All registered queries with the SQL that each equals."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import tarnflow.plans as package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _info in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
    if _info.name.startswith("q_"):
        _module = importlib.import_module(f"{package.__name__}.{_info.name}")
        QUERIES.update(_module.QUERIES)
        ORACLES.update(_module.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment, masked, with their orders and lines counted through the cascade."""
    return QUERIES["flagship"](spark, sf_dir)
