"""All registered queries and their oracles."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ("stock_queries", "parse_queries", "catalog_queries", "library_queries", "locate_queries", "evidence_queries", "gate_queries", "store_queries")
_MODULES = [import_module(f"lotledger.plans.{g}") for g in _GROUPS]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
