"""All queries of the library, by name."""

from __future__ import annotations

import importlib

from tessera.plans.dialect import REGISTRY

for _module in ("similarity", "fusion", "events", "telemetry", "process_control", "validation", "udf_operators", "extraction", "clones", "over_tables"):
    importlib.import_module(f"tessera.operators.{_module}")

QUERIES = REGISTRY.queries()
ORACLES = REGISTRY.oracles()
