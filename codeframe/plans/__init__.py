"""Named queries over the canonical tables, each with an independent SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeframe.plans import q_functions, q_graph, q_more, q_search, q_sources, q_store  # noqa: F401  (they register)
from codeframe.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked full-text search."""
    return QUERIES["R1_bm25"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
