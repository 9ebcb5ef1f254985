"""All registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import importlib
import pkgutil
import re

import tarnflow.llm as package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _info in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
    if re.match(r"q\d+_", _info.name):
        _module = importlib.import_module(f"{package.__name__}.{_info.name}")
        QUERIES.update(_module.QUERIES)
        ORACLES.update(_module.ORACLES)
