"""Every query of the engine by inventory id, with the SQL that must agree."""

from __future__ import annotations

import importlib

from quernstone.queries.registry import QUERIES, SQL

MODULES = ("windows", "joins", "aggregates", "recurrences", "scalars", "simulators", "validation", "ledger", "streams", "supporting")

for _name in MODULES:
    importlib.import_module(f"quernstone.queries.{_name}")

__all__ = ["QUERIES", "SQL"]
