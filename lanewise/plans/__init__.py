"""Registered queries, their SQL, and the projections they read."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from . import chain_queries, columns, graph_queries, history_queries, layer_queries, model_queries, source_queries, tile_queries  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
