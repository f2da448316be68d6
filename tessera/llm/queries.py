"""The ``opN_<name>`` queries: each applies one operator to its whole table; their SQL where SQL can say it."""

from __future__ import annotations

import importlib

#: Modules with ``NAME``, ``query(spark, sf_dir)`` and, perhaps, ``ORACLE``.
_MODULES = (
    "q_quality",
    "q_secrets",
    "q_near",
    "q_pages",
    "q_licenses",
    "q_language",
    "q_pieces",
    "q_leaks",
    "q_substrings",
    "q_lines",
    "q_tokens",
    "q_conversations",
    "q_negatives",
)

_loaded = [importlib.import_module(f"tessera.llm.{m}") for m in _MODULES]
QUERIES = {m.NAME: m.query for m in _loaded}
ORACLES = {m.NAME: m.ORACLE for m in _loaded if getattr(m, "ORACLE", None)}
