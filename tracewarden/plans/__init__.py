"""All registered queries, one module per group of operators."""

from __future__ import annotations

import importlib

from tracewarden.plans.registry import ORACLES, QUERIES

GROUPS = ["windows", "chains", "columns", "rules", "knowledge", "flows", "verdicts"]


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"tracewarden.plans.{group}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
