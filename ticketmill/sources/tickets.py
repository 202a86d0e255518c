"""The stored ticket table: Parquet, partitioned by closing month and ingest.

Batch writes and ingests store tickets in the same layout, ``closed_month`` and
then ``ingest_id``, so reports read what ingests insert. Open tickets lie under
the month OPEN_MONTH.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketmill.functions.timecalc import ntz_literal, wall_clock
from ticketmill.operators.filters import check_range, in_closed_months
from ticketmill.sources.schemas import TICKETS

TIME_COLUMNS = ("created_at", "closed_at")
OPEN_MONTH = "open"
LOADED = -1  # ingest_id of tickets that no ingest brought


def write_tickets(tickets: DataFrame, path: str, mode: str = "append", ingest_id: int = LOADED) -> None:
    """Write tickets by closing month, as those of one ingest.

    The rebalance hint lets AQE split a month that holds much of the data and
    merge small ones, so file sizes follow the data and not the month. With mode
    ``replace`` the folders of this ingest in the months at hand are replaced
    and all others stay.
    """
    month = F.coalesce(F.substring(F.col("closed_at").cast("string"), 1, 7), F.lit(OPEN_MONTH))
    rows = tickets.withColumns({"closed_month": month, "ingest_id": F.lit(ingest_id).cast("bigint")})
    writer = rows.hint("rebalance", "closed_month").write.partitionBy("closed_month", "ingest_id")
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode(mode)
    writer.parquet(path)


def _check_layout(spark: SparkSession, path: str) -> None:
    """Raise where the folder is not partitioned by closing month: a report on it would be silently empty."""
    if "closed_month" not in spark.read.parquet(path).columns:
        raise ValueError(f"{path} is not partitioned by closed_month")


def read_tickets(
    spark: SparkSession, path: str, tz: str = "UTC", d_from=None, d_to=None, instants: bool = False
) -> DataFrame:
    """Scan stored tickets with a fixed schema; times come out as wall-clock in ``tz``.

    ``instants`` says that the times are stored as instants (TIMESTAMP); they are
    converted here, once. Conversion hides the column from Parquet pushdown, so
    the optional day range is also applied to the stored column, a day wider on
    both sides, before conversion. Wall-clock columns are passed on bare.
    """
    _check_layout(spark, path)
    schema = T.StructType(
        [T.StructField(f.name, T.TimestampType(), True) if instants and f.name in TIME_COLUMNS else f for f in TICKETS]
        + [T.StructField("closed_month", T.StringType(), True), T.StructField("ingest_id", T.LongType(), True)]
    )
    tickets = spark.read.schema(schema).parquet(path)
    bounds = check_range(d_from, d_to) if d_from is not None and d_to is not None else None
    if bounds and not instants:
        tickets = in_closed_months(tickets, *bounds)
    if instants:
        if bounds:
            lo, hi = bounds[0] - timedelta(days=1), bounds[1] + timedelta(days=2)
            tickets = in_closed_months(tickets, lo, hi).where(
                (F.col("closed_at") >= F.to_timestamp_ltz(F.lit(f"{lo}T00:00:00Z")))
                & (F.col("closed_at") < F.to_timestamp_ltz(F.lit(f"{hi}T00:00:00Z")))
            )
        tickets = tickets.withColumns({c: wall_clock(F.col(c), tz) for c in TIME_COLUMNS})
    if bounds:
        tickets = tickets.where(
            (F.col("closed_at") >= ntz_literal(bounds[0]))
            & (F.col("closed_at") < ntz_literal(bounds[1] + timedelta(days=1)))
        )
    return tickets
