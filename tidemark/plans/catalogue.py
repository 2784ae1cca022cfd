"""All named queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import dose_queries, kernel_queries, lookup_queries, more_queries, panel_queries, regression_queries, screening_queries, source_queries, text_queries  # noqa: F401
from tidemark.plans.registry import oracles, queries

__all__ = ["entry", "oracles", "queries"]


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: the calendar-aligned return panel."""
    return panel_queries.spine_aligned_panel(spark, folder)
