"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "A04_group_reward_norm"
QUERIES: dict = {}
SQL: dict = {}
for _name in ("group", "sequence", "metric", "order", "lookup", "trace", "text", "record", "stream", "hook", "case"):
    try:
        _book = import_module(f"siltstone.plans.{_name}_queries").book
    except ModuleNotFoundError as e:
        if e.name != f"siltstone.plans.{_name}_queries":
            raise
        continue
    _both = QUERIES.keys() & _book.queries.keys()
    if _both:
        raise ValueError(f"twice in the catalogue: {sorted(_both)}")
    QUERIES.update(_book.queries)
    SQL.update(_book.sql)
