"""All queries of this package and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
SQL: dict = {}
for _name in ("p1", "p2", "p3", "p4", "p5", "p6", "p7"):
    try:
        _module = import_module(f"siltstone.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"siltstone.llm.{_name}":
            raise
        continue
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
