"""Named queries and the SQL that says the same."""

from __future__ import annotations

import importlib

MODULES = ("snapshots", "nested", "governance", "lines", "python_code", "graphs", "integrity", "structure", "claims", "audits")


def _loaded():
    return [importlib.import_module(f"codeloom.plans.{m}") for m in MODULES]


def all_queries() -> dict:
    return {k: v for m in _loaded() for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _loaded() for k, v in m.ORACLE.items()}
