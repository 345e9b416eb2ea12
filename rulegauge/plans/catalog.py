"""All registered queries."""

from __future__ import annotations

import importlib

from rulegauge.plans.base import ORACLES, QUERIES

FAMILIES = ("intake", "routing", "rules", "obligations", "ledgers", "audit", "graphs", "scores", "streams")

for _family in FAMILIES:
    importlib.import_module(f"rulegauge.plans.{_family}")

__all__ = ["ORACLES", "QUERIES"]
