"""Calendar and business-time arithmetic on TIMESTAMP_NTZ columns.

Every function here is a plain column expression, so it stays inside the scan
stage's generated code and needs no shuffle. None depends on the session zone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MONDAY = 4  # 1970-01-05 as days since 1970-01-01; any Monday will do


@dataclass(frozen=True)
class WorkingHours:
    """Opening and closing time of a working day, and the working weekdays (Monday = 0)."""

    opens: time = time(7)
    closes: time = time(17)
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)

    def __post_init__(self):
        if self.opens >= self.closes:
            raise ValueError("working hours must open before they close")
        if not set(self.weekdays) <= set(range(7)):
            raise ValueError("weekdays are 0 (Monday) to 6 (Sunday)")

    @staticmethod
    def _seconds(t: time) -> int:
        return t.hour * 3600 + t.minute * 60 + t.second

    @property
    def open_seconds(self) -> int:
        return self._seconds(self.opens)

    @property
    def close_seconds(self) -> int:
        return self._seconds(self.closes)


STANDARD_HOURS = WorkingHours()


def ntz_literal(value: date | datetime) -> Column:
    """A TIMESTAMP_NTZ literal, so that comparisons with a bare column push down."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else f"{value.isoformat()} 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def wall_clock_value(value: datetime, tz: str = "UTC") -> datetime:
    """A Python instant as wall-clock time in ``tz``; naive values are taken as they are."""
    return value if value.tzinfo is None else value.astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def wall_clock(instant: Column, tz: str = "UTC") -> Column:
    """A TIMESTAMP column as wall-clock TIMESTAMP_NTZ in ``tz``, whatever the session zone."""
    utc = ntz_literal(date(1970, 1, 1)) + F.unix_micros(instant) * F.expr("interval '0.000001' second")
    return utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def as_instant(ts: Column) -> Column:
    """The TIMESTAMP that reads as ``ts`` in UTC, whatever the session zone."""
    since_epoch = (ts - ntz_literal(date(1970, 1, 1))).cast("interval second")
    return F.timestamp_seconds(since_epoch.cast("decimal(18,6)"))


def _whole(span: Column) -> Column:
    """Whole seconds of an interval, cut toward zero."""
    return span.cast("interval second").cast("bigint")


def _half_second() -> Column:
    return F.expr("interval '0.5' second")


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to a later ``end``, halves rounded up."""
    return _whole(end - start + _half_second())


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")


def sunday_first_weekday(day: Column) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(day) - 1


def at_time(day: Column, seconds: int) -> Column:
    """A date plus a time of day."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def _days_since_monday(day: Column) -> Column:
    return F.unix_date(day) - MONDAY


def _day_of_week(day: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.pmod(_days_since_monday(day), F.lit(7))


def _working_days_started(in_week: Column, hours: WorkingHours) -> Column:
    """Working days of a week before its day number ``in_week``."""
    days = sorted(set(hours.weekdays))
    if days == list(range(len(days))):
        return F.least(in_week, F.lit(len(days)))
    return reduce(lambda a, b: a + b, [(in_week > w).cast("int") for w in days], F.lit(0))


def is_working_day(day: Column, hours: WorkingHours = STANDARD_HOURS) -> Column:
    days = sorted(set(hours.weekdays))
    in_week = _day_of_week(day)
    return in_week < len(days) if days == list(range(len(days))) else in_week.isin(*days)


def working_days_before(day: Column, hours: WorkingHours = STANDARD_HOURS) -> Column:
    """Working days from the fixed Monday up to, not including, ``day`` (negative before it)."""
    in_week = _day_of_week(day)
    whole_weeks = F.call_function("div", _days_since_monday(day) - in_week, F.lit(7))
    return whole_weeks * len(set(hours.weekdays)) + _working_days_started(in_week, hours)


def seconds_in_window(day: Column, created: Column, closed: Column, hours: WorkingHours = STANDARD_HOURS) -> Column:
    """Whole working seconds of one calendar day, clipped to the ticket's life."""
    lo = F.greatest(at_time(day, hours.open_seconds), created)
    hi = F.least(at_time(day, hours.close_seconds), closed)
    inside = is_working_day(day, hours) & (hi > lo)
    return F.when(inside, whole_seconds(lo, hi)).otherwise(F.lit(0).cast("bigint"))


def has_open_days(created: Column, closed: Column) -> Column:
    """True where the ticket was closed on or after the day it was created."""
    return created.isNotNull() & closed.isNotNull() & (day_of(created) <= day_of(closed))


def business_seconds(created: Column, closed: Column, hours: WorkingHours = STANDARD_HOURS) -> Column:
    """Working seconds between two wall-clock times; NULL where ``has_open_days`` is false.

    Only the first and last day can be partial; the days between are counted
    from their dates, so no row per day is made. Each day is rounded on its own,
    halves up: opening and closing times are whole seconds, so a part that
    starts at a time rounds that time half down, and one that ends at a time
    rounds it half up. It is all BIGINT arithmetic, to keep generated code small.
    """
    first, last = day_of(created), day_of(closed)
    full_day = hours.close_seconds - hours.open_seconds
    just_below_half = F.expr("interval '0.499999' second")
    starts = _whole(created - first.cast("timestamp_ntz") + just_below_half)
    ends = _whole(closed - last.cast("timestamp_ntz") + _half_second())

    def part(seconds: Column) -> Column:
        return F.greatest(F.least(seconds, F.lit(full_day).cast("bigint")), F.lit(0).cast("bigint"))

    none = F.lit(0).cast("bigint")
    missed_on_first = F.when(is_working_day(first, hours), part(hours.close_seconds - starts) - full_day).otherwise(none)
    worked_on_last = F.when(is_working_day(last, hours), part(ends - hours.open_seconds)).otherwise(none)
    days_from_first = (working_days_before(last, hours) - working_days_before(first, hours)).cast("bigint")
    return F.when(first == last, seconds_in_window(first, created, closed, hours)).when(
        first < last, days_from_first * full_day + missed_on_first + worked_on_last
    )
