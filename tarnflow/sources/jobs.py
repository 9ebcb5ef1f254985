"""Jobs from the environment: ``<PREFIX>_<JOB>_{ENABLED,SOURCE_URI,DESTINATION_URI,CONFIG_PATH}``."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from tarnflow.sources.catalog import check_apart

PREFIX = "FLOW"


@dataclass(frozen=True)
class Job:
    id: str
    source_uri: str
    destination_uri: str
    config_path: str | None = None
    enabled: bool = True


def valid_uri(uri: str | None) -> bool:
    """An absolute path or a URI with a path."""
    return bool(uri) and bool(re.match(r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*://?)\S+$", uri.strip()))


def jobs(environ: dict | None = None, prefix: str = PREFIX) -> dict[str, Job]:
    """All enabled jobs, by lower-case id."""
    env = os.environ if environ is None else environ
    out = {}
    for key, value in env.items():
        m = re.fullmatch(rf"{prefix}_(.+)_ENABLED", key)
        if m and value.strip().lower() in ("true", "1", "yes"):
            out[m[1].lower()] = get_job(m[1], env, prefix)
    return dict(sorted(out.items()))


def get_job(name: str, environ: dict | None = None, prefix: str = PREFIX) -> Job:
    """One job; ValueError if it is not enabled or lacks a place."""
    env = os.environ if environ is None else environ
    get = lambda part: (env.get(f"{prefix}_{name.upper()}_{part}") or "").strip()
    if get("ENABLED").lower() not in ("true", "1", "yes"):
        raise ValueError(f"job {name!r} is not enabled")
    for part in ("SOURCE_URI", "DESTINATION_URI"):
        if not valid_uri(get(part)):
            raise ValueError(f"job {name!r} needs a valid {part}")
    check_apart(get("SOURCE_URI"), get("DESTINATION_URI"))
    return Job(name.lower(), get("SOURCE_URI"), get("DESTINATION_URI"), get("CONFIG_PATH") or None)
