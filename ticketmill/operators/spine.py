"""Calendar spines: every day or month of a range, gaps filled with 0."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: date, last: date, step: str, name: str) -> DataFrame:
    """One row per ``step`` (``day`` or ``month``) from ``first`` to ``last``."""
    days = F.sequence(F.lit(first), F.lit(last), F.expr(f"interval 1 {step}"))
    return spark.range(1).select(F.explode(days).alias(name))


def fill_gaps(spine: DataFrame, counts: DataFrame, on: str, count: str = "count") -> DataFrame:
    """Left join of aggregated counts onto a spine; missing counts become 0."""
    return spine.join(counts, on, "left").select(on, F.coalesce(count, F.lit(0).cast("bigint")).alias(count))
