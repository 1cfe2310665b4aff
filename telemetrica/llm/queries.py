"""The queries of this subpackage and their DuckDB oracles, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("token_counts", "sentence_pieces", "chat_format", "packing", "secrets", "quality_rules", "near_duplicates", "additive_search", "html_extract", "toxicity")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"telemetrica.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
