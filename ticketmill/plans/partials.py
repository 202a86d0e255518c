"""Reports from stored daily partials (``operators/partials``): a few rows a day are summed instead of all tickets.

Means are taken from the summed seconds, so they equal those from tickets. Working hours are those that the
partials were written with. The slowest cases need the tickets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.labels import month_label, pair_label, percent_share
from ticketmill.operators.filters import check_limit, check_range
from ticketmill.operators.spine import calendar, fill_gaps
from ticketmill.plans.counts import DEFAULT_TOP, most_frequent_first
from ticketmill.plans.resolution import mean_hours


def _of_kind(partials: DataFrame, kind: str, d_from, d_to) -> DataFrame:
    first, last = check_range(d_from, d_to)
    return partials.where((F.col("kind") == kind) & F.col("day").between(F.lit(first), F.lit(last)))


def _counts(partials: DataFrame, kind: str, d_from, d_to, **labels: str) -> DataFrame:
    rows = _of_kind(partials, kind, d_from, d_to).select(*[F.col(c).alias(name) for name, c in labels.items()], "count")
    return rows.groupBy(*labels).agg(F.sum("count").alias("count"))


def top_categories(partials: DataFrame, d_from, d_to, top: int = DEFAULT_TOP) -> DataFrame:
    return most_frequent_first(_counts(partials, "category", d_from, d_to, category="label"), check_limit(top))


def tickets_by_source(partials: DataFrame, d_from, d_to) -> DataFrame:
    counts = _counts(partials, "source", d_from, d_to, source="label")
    total = counts.agg(F.sum("count")).scalar()
    return most_frequent_first(counts, None).withColumn("pct", percent_share(F.col("count"), total))


def top_agents(partials: DataFrame, d_from, d_to, top: int = DEFAULT_TOP) -> DataFrame:
    return most_frequent_first(_counts(partials, "agent", d_from, d_to, agent="label"), check_limit(top))


def top_subcategories(partials: DataFrame, d_from, d_to, top: int | None = None) -> DataFrame:
    counts = _counts(partials, "category", d_from, d_to, category="label", subcategory="detail")
    ordered = most_frequent_first(counts, top if top and top > 0 else None)
    return ordered.withColumn("label", pair_label(F.col("category"), F.col("subcategory")))


def closed_total(partials: DataFrame, d_from, d_to) -> DataFrame:
    counted = _of_kind(partials, "source", d_from, d_to).agg(F.sum("count").alias("n"))
    return counted.select(F.coalesce("n", F.lit(0).cast("bigint")).alias("total_closed"))


def closed_daily(partials: DataFrame, d_from, d_to) -> DataFrame:
    first, last = check_range(d_from, d_to)
    counts = _counts(partials, "source", first, last, day="day")
    days = fill_gaps(calendar(partials.sparkSession, first, last, "day", "day"), counts, "day")
    return days.orderBy("day").select(F.col("day").cast("string").alias("date"), "count")


def closed_monthly(partials: DataFrame, d_from, d_to) -> DataFrame:
    first, last = check_range(d_from, d_to)
    closed = _of_kind(partials, "source", first, last).select(F.trunc("day", "month").alias("month"), "count")
    counts = closed.groupBy("month").agg(F.sum("count").alias("count"))
    spine = calendar(partials.sparkSession, first.replace(day=1), last, "month", "month")
    return (
        fill_gaps(spine, counts, "month").orderBy("month").select("month", month_label(F.col("month")).alias("date"), "count")
    )


def _means(partials: DataFrame, kind: str, d_from, d_to, name: str, tickets: str) -> DataFrame:
    timed = _of_kind(partials, kind, d_from, d_to).where("timed > 0")
    sums = timed.groupBy(F.col("label").alias(name)).agg(F.sum("timed").alias(tickets), F.sum("seconds").alias("seconds"))
    return sums.select(name, tickets, mean_hours(F.col("seconds"), F.col(tickets)).alias("avg_hours_business"))


def resolution_by_agent(partials: DataFrame, d_from, d_to, top: int | None = None) -> DataFrame:
    means = _means(partials, "agent_name", d_from, d_to, "agent", "total_closed")
    ordered = means.orderBy(F.asc("avg_hours_business"), F.desc("total_closed"), F.asc("agent"))
    return ordered if top is None else ordered.limit(check_limit(top))


def resolution_by_source(partials: DataFrame, d_from, d_to, order: str = "asc") -> DataFrame:
    means = _means(partials, "source", d_from, d_to, "source", "tickets")
    mean = F.col("avg_hours_business")
    by_mean = mean.desc() if (order or "").lower() == "desc" else mean.asc()
    return means.orderBy(by_mean, F.desc("tickets"), F.asc("source"))


def resolution_overall(partials: DataFrame, d_from, d_to) -> DataFrame:
    sums = _of_kind(partials, "source", d_from, d_to).agg(F.sum("timed").alias("n"), F.sum("seconds").alias("seconds"))
    total = F.coalesce("n", F.lit(0).cast("bigint"))
    mean = F.coalesce(mean_hours(F.col("seconds"), total), F.lit(0.0))
    return sums.select(mean.alias("avg_hours_business"), total.alias("total_closed"))
