"""All registered queries (name -> (spark, sf_dir) -> DataFrame) and oracles."""
from __future__ import annotations

import importlib

_GROUPS = (
    "clinlytics.plans.catalog_jobs",
    "clinlytics.plans.catalog_dash",
    "clinlytics.plans.catalog_rag",
    "clinlytics.plans.catalog_writes",
    "clinlytics.plans.catalog_sinks",
    "clinlytics.plans.catalog_stream",
)


def _merge(attr: str) -> dict:
    out: dict = {}
    for mod in _GROUPS:
        part = getattr(importlib.import_module(mod), attr)
        dup = set(out) & set(part)
        if dup:
            raise ValueError(f"duplicate query names {sorted(dup)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict:
    return _merge("ORACLES")
