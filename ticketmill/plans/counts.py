"""Ticket counts by category, subcategory, source and agent.

Group labels are few next to the tickets, so partial aggregation in the scan
stage reduces even a label that covers most rows to one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.labels import (
    agent_label,
    category_label,
    pair_label,
    percent_share,
    source_label,
    subcategory_label,
)
from ticketmill.operators.filters import check_limit, closed_between

DEFAULT_TOP = 10


def _count_by(tickets: DataFrame, **labels: Column) -> DataFrame:
    """Counts per label; labels are computed first, so that a label may share a raw column's name."""
    return tickets.select(*[c.alias(name) for name, c in labels.items()]).groupBy(*labels).agg(F.count("*").alias("count"))


def most_frequent_first(counts: DataFrame, top: int | None) -> DataFrame:
    """Largest count first, ties by label; with ``top`` a top-k, not a full sort."""
    labels = [F.col(c).asc() for c in counts.columns if c != "count"]
    ordered = counts.orderBy(F.col("count").desc(), *labels)
    return ordered if top is None else ordered.limit(check_limit(top))


def returned_total(report: DataFrame) -> DataFrame:
    """Sum of the counts a report returned, after its limit; one row."""
    return report.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total"))


def total_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.agg(F.count("*").alias("total_tickets"))


def category_counts(tickets: DataFrame, top: int | None = None) -> DataFrame:
    """Tickets per stored category, blank ones included, missing ones left out."""
    present = tickets.where(F.col("category").isNotNull())
    return most_frequent_first(_count_by(present, category=F.col("category")), top)


def top_categories(tickets: DataFrame, d_from, d_to, top: int = DEFAULT_TOP) -> DataFrame:
    in_range = closed_between(tickets, d_from, d_to)
    return most_frequent_first(_count_by(in_range, category=category_label()), check_limit(top))


def tickets_by_source(tickets: DataFrame, d_from, d_to) -> DataFrame:
    """Tickets per source with their share of the total in percent."""
    counts = _count_by(closed_between(tickets, d_from, d_to), source=source_label())
    total = counts.agg(F.sum("count")).scalar()
    return most_frequent_first(counts, None).withColumn("pct", percent_share(F.col("count"), total))


def top_agents(tickets: DataFrame, d_from, d_to, top: int = DEFAULT_TOP) -> DataFrame:
    in_range = closed_between(tickets, d_from, d_to)
    return most_frequent_first(_count_by(in_range, agent=agent_label()), check_limit(top))


def top_subcategories(tickets: DataFrame, d_from, d_to, top: int | None = None) -> DataFrame:
    """Pairs of category and subcategory; no limit for ``None``, zero or a negative ``top``."""
    in_range = closed_between(tickets, d_from, d_to)
    counts = _count_by(in_range, category=category_label(), subcategory=subcategory_label())
    ordered = most_frequent_first(counts, top if top and top > 0 else None)
    return ordered.withColumn("label", pair_label(F.col("category"), F.col("subcategory")))
