"""Time to resolve in business hours.

Seconds are computed per ticket inside the scan stage; averages are whole
arithmetic on summed seconds, so a ticket key never has to be shuffled. Tickets
without a creation time, or closed on a day before it, are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.labels import agent_name_label, source_label, whole_div
from ticketmill.functions.timecalc import STANDARD_HOURS, WorkingHours, business_seconds, has_open_days
from ticketmill.operators.filters import check_limit, closed_between
from ticketmill.sources.schemas import TICKET_KEY


def mean_hours(seconds: Column, tickets: Column) -> Column:
    """Mean hours to two decimals, halves up, from total seconds and a ticket count."""
    return whole_div(2 * seconds + 36 * tickets, 72 * tickets) / F.lit(100.0)


def business_time(tickets: DataFrame, d_from, d_to, hours: WorkingHours = STANDARD_HOURS) -> DataFrame:
    """Tickets closed in the range that have an open day, with ``business_seconds``."""
    created, closed = F.col("created_at"), F.col("closed_at")
    counted = closed_between(tickets, d_from, d_to).where(has_open_days(created, closed))
    return counted.withColumn("business_seconds", business_seconds(created, closed, hours))


def _mean_by(timed: DataFrame, name: str, label: Column, tickets: str) -> DataFrame:
    return (
        timed.select(label.alias(name), "business_seconds")
        .groupBy(name)
        .agg(F.count("*").alias(tickets), F.sum("business_seconds").alias("seconds"))
        .select(name, tickets, mean_hours(F.col("seconds"), F.col(tickets)).alias("avg_hours_business"))
    )


def resolution_by_agent(
    tickets: DataFrame, d_from, d_to, top: int | None = None, hours: WorkingHours = STANDARD_HOURS
) -> DataFrame:
    """Mean business hours per agent, fastest first; all agents unless ``top`` is given."""
    means = _mean_by(business_time(tickets, d_from, d_to, hours), "agent", agent_name_label(), "total_closed")
    ordered = means.orderBy(F.asc("avg_hours_business"), F.desc("total_closed"), F.asc("agent"))
    return ordered if top is None else ordered.limit(check_limit(top))


def resolution_overall(tickets: DataFrame, d_from, d_to, hours: WorkingHours = STANDARD_HOURS) -> DataFrame:
    """Mean business hours of all counted tickets; 0.0 when there are none."""
    totals = business_time(tickets, d_from, d_to, hours).agg(
        F.count("*").alias("total_closed"), F.sum("business_seconds").alias("seconds")
    )
    mean = F.coalesce(mean_hours(F.col("seconds"), F.col("total_closed")), F.lit(0.0))
    return totals.select(mean.alias("avg_hours_business"), "total_closed")


def resolution_by_source(
    tickets: DataFrame, d_from, d_to, order: str = "asc", hours: WorkingHours = STANDARD_HOURS
) -> DataFrame:
    """Mean business hours per source; ``desc`` puts the slowest first, anything else the fastest."""
    means = _mean_by(business_time(tickets, d_from, d_to, hours), "source", source_label(), "tickets")
    mean = F.col("avg_hours_business")
    by_mean = mean.desc() if (order or "").lower() == "desc" else mean.asc()
    return means.orderBy(by_mean, F.desc("tickets"), F.asc("source"))


def slow_cases(tickets: DataFrame, d_from, d_to, top: int = 10, hours: WorkingHours = STANDARD_HOURS) -> DataFrame:
    """The tickets with the most business hours; ties by closing time, newest first, then by id."""
    rounded = mean_hours(F.col("business_seconds"), F.lit(1).cast("bigint"))
    slowest = [F.desc("hours_business_resolution"), F.desc("closed_at"), F.asc(TICKET_KEY)]
    return (
        business_time(tickets, d_from, d_to, hours)
        .select(
            TICKET_KEY,
            "subject",
            agent_name_label().alias("owner_name"),
            source_label().alias("source"),
            "created_at",
            "closed_at",
            rounded.alias("hours_business_resolution"),
            F.col(TICKET_KEY).alias("label"),
        )
        .orderBy(*slowest)
        .limit(check_limit(top))
    )
