"""Queries of the layout engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import elements, more, scalars

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**scalars.QUERIES, **elements.QUERIES, **more.QUERIES}
ORACLE: dict[str, str] = {**scalars.ORACLE, **elements.ORACLE, **more.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element counts by page and type of the fast analysis."""
    return QUERIES["c07_fast_counts"](spark, sf_dir)
