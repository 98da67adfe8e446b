"""All registered queries with their SQL; each module of `plans` holds some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardloom.plans import cards, documents, events, vectors

PLANS = [documents, vectors, cards, events]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for module in PLANS for name, plan in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in PLANS for name, sql in module.ORACLES.items()}
