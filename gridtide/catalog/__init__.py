"""The registered queries over the given tables, with their SQL oracles."""

from __future__ import annotations

import importlib

GROUPS = ("strategy_queries", "feature_queries", "scoring_queries", "model_queries")


def registered() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for group in GROUPS:
        module = importlib.import_module(f"gridtide.catalog.{group}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
