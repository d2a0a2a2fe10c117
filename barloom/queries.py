"""Registered queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

FLAGSHIP = "c10_build_master"
MODULES = ["queries_base", "queries_features", "queries_graph", "queries_evaluate", "queries_portfolio"]


def _modules():
    return [importlib.import_module(f"barloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: fn for m in _modules() for k, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.ORACLES.items()}
