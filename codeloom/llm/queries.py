"""All queries of the subpackage and the SQL that says the same."""

from __future__ import annotations

import importlib

_MODULES = ("syntax", "handwritten", "credentials", "packing", "mixing", "residue")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in _MODULES:
    _found = importlib.import_module(f"codeloom.llm.plans.{_m}")
    QUERIES |= _found.QUERIES
    ORACLE |= _found.ORACLE
