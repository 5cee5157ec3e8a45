"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import edit_plans, formula_plans, log_plans, operation_plans, package_plans, table_plans, text_plans

MODULES = (text_plans, table_plans, log_plans, edit_plans, package_plans, operation_plans, formula_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
