"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [import_module(f"tessera.llm.{name}") for name in ("op1_query", "op2_query", "op3_query", "op4_query", "op5_query", "op6_query", "op7_query", "op8_query", "op9_query", "op10_query", "op11_query", "op12_query", "op13_query")]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
