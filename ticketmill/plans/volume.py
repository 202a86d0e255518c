"""Closed tickets over time, with gaps shown as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.labels import month_label
from ticketmill.functions.timecalc import day_of, month_of
from ticketmill.operators.filters import check_range, closed_between
from ticketmill.operators.spine import calendar, fill_gaps

MAX_DAILY_DAYS = 40  # fixed value: longer ranges are shown by month


def closed_total(tickets: DataFrame, d_from, d_to) -> DataFrame:
    return closed_between(tickets, d_from, d_to).agg(F.count("*").alias("total_closed"))


def closed_daily(tickets: DataFrame, d_from, d_to) -> DataFrame:
    """``date`` (text, ISO) and ``count`` for every day of the range."""
    first, last = check_range(d_from, d_to)
    closed = closed_between(tickets, first, last).select(day_of(F.col("closed_at")).alias("day"))
    counts = closed.groupBy("day").agg(F.count("*").alias("count"))
    days = fill_gaps(calendar(tickets.sparkSession, first, last, "day", "day"), counts, "day")
    return days.orderBy("day").select(F.col("day").cast("string").alias("date"), "count")


def closed_monthly(tickets: DataFrame, d_from, d_to) -> DataFrame:
    """``month`` (its first day), ``date`` (month name and year) and ``count`` for every month."""
    first, last = check_range(d_from, d_to)
    closed = closed_between(tickets, first, last).select(month_of(F.col("closed_at")).alias("month"))
    counts = closed.groupBy("month").agg(F.count("*").alias("count"))
    spine = calendar(tickets.sparkSession, first.replace(day=1), last, "month", "month")
    return (
        fill_gaps(spine, counts, "month").orderBy("month").select("month", month_label(F.col("month")).alias("date"), "count")
    )


def volume_grain(d_from, d_to) -> str:
    """``total`` for one day, ``daily`` up to 40 days, else ``monthly``."""
    first, last = check_range(d_from, d_to)
    if first == last:
        return "total"
    return "daily" if (last - first).days + 1 <= MAX_DAILY_DAYS else "monthly"


def closed_volume(tickets: DataFrame, d_from, d_to, grain: str = "auto") -> DataFrame:
    """``grain``, ``period`` (its first day, ISO), ``date`` (as shown) and ``count`` at one of three grains.

    ``grain`` is ``total``, ``daily`` or ``monthly``; ``auto`` takes the one that
    fits the range, by the arguments alone. The columns are the same for all.
    """
    grain = volume_grain(d_from, d_to) if grain == "auto" else grain
    first, _ = check_range(d_from, d_to)
    if grain == "total":
        start = F.lit(first.isoformat())
        rows = closed_total(tickets, d_from, d_to).select(start.alias("period"), start.alias("date"), F.col("total_closed").alias("count"))
    elif grain == "daily":
        rows = closed_daily(tickets, d_from, d_to).select(F.col("date").alias("period"), "date", "count")
    elif grain == "monthly":
        rows = closed_monthly(tickets, d_from, d_to).select(F.col("month").cast("string").alias("period"), "date", "count")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return rows.select(F.lit(grain).alias("grain"), "period", "date", "count")
