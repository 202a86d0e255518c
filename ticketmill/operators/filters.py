"""Range checks and pushable filters."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.timecalc import ntz_literal


def parse_day(value: str | date) -> date:
    """An ISO date; the time of an ISO date-time is dropped."""
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else datetime.fromisoformat(value).date()


def check_range(d_from: str | date, d_to: str | date) -> tuple[date, date]:
    """Both days of a report range; ``ValueError`` for a bad date or a reversed range."""
    first, last = parse_day(d_from), parse_day(d_to)
    if first > last:
        raise ValueError("'from' must not be later than 'to'")
    return first, last


def check_limit(n: int) -> int:
    if n < 0:
        raise ValueError("a row limit must not be negative")
    return n


def in_closed_months(tickets: DataFrame, first: date, last: date) -> DataFrame:
    """Prune partitions of a table stored by closing month; no effect on other frames."""
    if "closed_month" not in tickets.columns:
        return tickets
    return tickets.where(F.col("closed_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))


def closed_between(tickets: DataFrame, d_from: str | date, d_to: str | date) -> DataFrame:
    """Tickets closed on the days ``d_from`` to ``d_to``, both included.

    The bounds are half-open on the bare column, so they reach the Parquet scan.
    """
    first, last = check_range(d_from, d_to)
    closed = F.col("closed_at")
    return in_closed_months(tickets, first, last).where(
        (closed >= ntz_literal(first)) & (closed < ntz_literal(last + timedelta(days=1)))
    )


def closed_since(tickets: DataFrame, since: datetime) -> DataFrame:
    """Tickets closed at or after a wall-clock time."""
    if "closed_month" in tickets.columns:
        tickets = tickets.where(F.col("closed_month") >= f"{since:%Y-%m}")
    return tickets.where(F.col("closed_at") >= ntz_literal(since))
