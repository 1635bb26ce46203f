"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query key {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the plan modules fills the registry.
    from tidewatch.plans import (q_sources, q_exprs, q_joins, q_aggs, q_windows,  # noqa: F401
                                 q_sets, q_state, q_detect, q_knowledge, q_audit, q_streaming)
    return REGISTRY
