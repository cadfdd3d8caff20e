"""All registered queries of the contact and outreach operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import identity_queries, operator_queries, page_queries, result_queries, scalar_queries, table_queries

MODULES = (identity_queries, scalar_queries, table_queries, page_queries, operator_queries, result_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision counts of comparing a new contact list with the outreach history."""
    return queries()["A03_run_metrics"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
