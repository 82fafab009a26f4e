"""The queries of this subpackage and their check SQL."""

from __future__ import annotations

import importlib

from panelmill.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("lm_scoring", "token_files", "captures", "packing", "embedding_dedup", "quality_rules", "mixing", "minhash",
           "personal_data", "piece_counts", "toxicity", "token_alignment", "source_divergence")


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"panelmill.llm.{module}")
    return QUERIES, ORACLES
