"""All queries of the engine's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import association, bridging, content, control, geometry, kernels, ledgers, projection, scores, texts

MODULES = [geometry, content, control, kernels, ledgers, association, projection, scores, texts, bridging]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
