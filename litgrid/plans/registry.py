"""All queries of the engine with their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litgrid.plans import budgets, chained, citing, flow, indexed, parsing, related, rendered, resolving, search, texts

MODULES = (search, chained, indexed, rendered, resolving, related, texts, budgets, citing, parsing, flow)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
