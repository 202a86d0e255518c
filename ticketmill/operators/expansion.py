"""One row per calendar day a ticket was open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.timecalc import (
    STANDARD_HOURS,
    WorkingHours,
    day_of,
    has_open_days,
    seconds_in_window,
    sunday_first_weekday,
)


def day_expansion(tickets: DataFrame, hours: WorkingHours = STANDARD_HOURS) -> DataFrame:
    """Every open day of every ticket, with its weekday (Sunday = 0) and working seconds.

    Rows grow with the time a ticket was open. Reports use ``business_seconds``
    instead, which gives the same totals with no extra rows.
    """
    created, closed = F.col("created_at"), F.col("closed_at")
    days = F.when(
        has_open_days(created, closed), F.sequence(day_of(created), day_of(closed), F.expr("interval 1 day"))
    )
    day = F.col("open_day")
    return tickets.withColumn("open_day", F.explode(days)).withColumns(
        {"dow": sunday_first_weekday(day), "work_seconds": seconds_in_window(day, created, closed, hours)}
    )
