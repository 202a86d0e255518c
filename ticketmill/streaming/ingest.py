"""Continuous ticket ingest: the first line of a ticket id wins.

Two forms. ``stream_ingest`` compares each micro-batch with the stored keys of all earlier ones: exact for
ever, and each batch reads the key buckets it needs. ``stream_ingest_within`` keeps the ids of a bounded time
in state and reads no key table: it fits feeds whose repeats come soon, such as a sender that retries.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticketmill.operators.ingest import begin_ingest, finish_ingest, ingest_lines
from ticketmill.operators.partials import write_partials
from ticketmill.session import staged
from ticketmill.sources.batches import parse_ticket_rows, split_ticket_rows
from ticketmill.sources.schemas import TICKET_KEY, TICKET_LINES, TICKETS
from ticketmill.sources.tickets import write_tickets


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Ticket lines (``pos``, ``line``) from JSON files as they arrive in a folder."""
    reader = spark.readStream.schema(TICKET_LINES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_ingest(lines: DataFrame, base: str, checkpoint: str, tz: str = "UTC") -> StreamingQuery:
    """Ingest all available lines; the first line of a key wins, then and in later runs.

    The micro-batch id names the output folders below ``base``, so a replayed
    micro-batch replaces its own rows and compares with earlier ones only. All
    folders must lie in shared storage.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_lines(batch, base, batch_id, tz)

    return (
        lines.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FIRST_LINES = "pos BIGINT, line STRING"


def first_lines(lines: DataFrame, within: timedelta, tz: str = "UTC") -> DataFrame:
    """The lines of a stream whose ticket id is not in state; an id stays there for ``within`` after its first line.

    Of the lines of one id in a micro-batch the least ``pos`` wins, which
    ``dropDuplicatesWithinWatermark`` leaves open; hence the state of our own.
    It holds an id and a timer. Event time is the time of the micro-batch that
    brings a line, so no line is ever too late, and one that comes after its id
    has expired counts as new.
    Lines that are no good tickets are left out (``stream_rejects`` has them).
    """
    hold_ms = int(within.total_seconds() * 1000)

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = pd.concat([part.nsmallest(1, "pos") for part in parts]).nsmallest(1, "pos")
        if not state.exists:
            state.update((True,))
            state.setTimeoutTimestamp(int(first["at_ms"].iloc[0]) + hold_ms)
            yield first[["pos", "line"]]

    valid = parse_ticket_rows(lines.select("pos", "line"), tz).where(F.col("error").isNull())
    timed = valid.select(TICKET_KEY, "pos", "line", F.current_timestamp().alias("at")).withWatermark("at", "0 seconds")
    return (
        timed.withColumn("at_ms", F.unix_millis("at"))
        .groupBy(TICKET_KEY)
        .applyInPandasWithState(keep, FIRST_LINES, "seen BOOLEAN", "append", GroupStateTimeout.EventTimeTimeout)
    )


def stream_ingest_within(lines: DataFrame, base: str, checkpoint: str, within: timedelta, tz: str = "UTC") -> StreamingQuery:
    """Ingest all available lines; the first line of a key wins over those that come ``within`` the time after it.

    The tables are those of ``stream_ingest`` without ``keys``: each micro-batch
    owns its folders, and its row in ``counts``, written last, makes it visible.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch.select("pos", "line"), f"{base}/staging")
        if rows.isEmpty():  # as in the micro-batches that only let ids expire
            return
        begin_ingest(batch.sparkSession, base, batch_id)
        valid, _ = split_ticket_rows(parse_ticket_rows(rows, tz))
        write_tickets(valid.select(*TICKETS.fieldNames(), "pos"), f"{base}/tickets", "replace", batch_id)
        write_partials(valid, f"{base}/partials", batch_id)
        counts = rows.agg(F.count("*").alias("inserted"))
        finish_ingest(counts, base, batch_id)

    return (
        first_lines(lines, within, tz)
        .writeStream.foreachBatch(store)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_rejects(lines: DataFrame, path: str, checkpoint: str, tz: str = "UTC") -> StreamingQuery:
    """Append the bad lines of all available files with their errors to ``path``."""
    _, rejected = split_ticket_rows(parse_ticket_rows(lines.select("pos", "line"), tz))
    return (
        rejected.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
