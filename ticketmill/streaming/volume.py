"""Closed tickets per day, counted as tickets arrive.

Two forms. ``stream_closed_daily`` keeps no state and takes every row, however late; its counts of a day may
still grow. ``stream_closed_windows`` keeps the open days in state and writes each day once, when the watermark
has passed its end: what it has written is final, and rows for a day that is final are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketmill.functions.timecalc import day_of
from ticketmill.operators.filters import check_range
from ticketmill.operators.spine import calendar, fill_gaps

DAY_COUNTS = "day DATE, count BIGINT, batch_id BIGINT"


def daily_counts(tickets: DataFrame) -> DataFrame:
    """Tickets per closing day."""
    closed = tickets.where(F.col("closed_at").isNotNull())
    return closed.groupBy(day_of(F.col("closed_at")).alias("day")).agg(F.count("*").alias("count"))


def stream_closed_daily(tickets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the counts of each micro-batch in a folder of its own.

    No row is too late and nothing is kept between batches: a replayed batch
    replaces its folder, and ``read_closed_daily`` adds up what is there.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        daily_counts(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        tickets.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_closed_daily(spark: SparkSession, path: str) -> DataFrame:
    """``day`` and ``count`` over all batches so far."""
    counts = spark.read.schema(DAY_COUNTS).parquet(path)
    return counts.groupBy("day").agg(F.sum("count").alias("count"))


FINAL_DAYS = "day DATE, count BIGINT"


def _as_instant(wall: Column) -> Column:
    """A wall-clock time as an instant, its fields read as UTC whatever the session zone: watermarks need TIMESTAMP."""
    return F.concat(wall.cast("string"), F.lit("Z")).cast("timestamp")


def windowed_counts(tickets: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tickets per closing day (``day``, ``count``) over event-time windows; on a stream, rows later than ``delay`` may be dropped."""
    closed = tickets.where(F.col("closed_at").isNotNull()).select(_as_instant(F.col("closed_at")).alias("closed_at"))
    days = closed.withWatermark("closed_at", delay).groupBy(F.window("closed_at", "1 day")).agg(F.count("*").alias("count"))
    day = F.date_from_unix_date(F.expr("CAST(unix_seconds(window.start) DIV 86400 AS INT)"))
    return days.select(day.alias("day"), "count")


def stream_closed_windows(tickets: DataFrame, path: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Append each day's count to ``path`` once the latest closing time is ``delay`` past the day's end.

    State holds the open days only. The file sink records which files belong to
    finished batches, so a restart from the checkpoint neither loses nor repeats a day.
    """
    return (
        windowed_counts(tickets, delay)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def read_closed_windows(spark: SparkSession, path: str, d_from=None, d_to=None) -> DataFrame:
    """``day`` and ``count`` of the days that are final; with a range, its days up to the last final one, gaps as 0."""
    days = spark.read.schema(FINAL_DAYS).parquet(path)
    if d_from is None or d_to is None:
        return days
    first, last = check_range(d_from, d_to)
    until = days.agg(F.max("day")).first()[0]  # one date
    known = days.where(F.col("day").between(F.lit(first), F.lit(last)))
    return fill_gaps(calendar(spark, first, last, "day", "day"), known, "day").where(F.col("day") <= F.lit(until).cast("date"))
