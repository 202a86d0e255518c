"""Stored daily partials: tickets and business seconds by closing day and label.

Counts and whole seconds add up, so reports over days (``plans/partials``) need not read the tickets. Each
ingest writes the partials of its own tickets; a label of a day may have a row per ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.functions.labels import agent_label, agent_name_label, category_label, source_label, subcategory_label
from ticketmill.functions.timecalc import STANDARD_HOURS, WorkingHours, business_seconds, day_of

PARTIALS = "day DATE, label STRING, detail STRING, count BIGINT, timed BIGINT, seconds BIGINT, kind STRING, ingest_id BIGINT"


def daily_partials(tickets: DataFrame, hours: WorkingHours = STANDARD_HOURS) -> DataFrame:
    """``day``, ``kind``, ``label``, ``detail`` with ``count``, ``timed`` (tickets with open days) and their ``seconds``.

    Kinds: ``source``, ``agent`` (name, else id), ``agent_name``, and ``category`` with the subcategory as
    ``detail``. A ticket counts once in each, by partial aggregation before the one shuffle.
    """

    def of(kind: str, label: Column, detail: Column | None = None) -> Column:
        detail = F.lit(None).cast("string") if detail is None else detail
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail"))

    kinds = F.array(
        of("source", source_label()),
        of("agent", agent_label()),
        of("agent_name", agent_name_label()),
        of("category", category_label(), subcategory_label()),
    )
    closed = F.col("closed_at")
    timed = tickets.where(closed.isNotNull()).select(
        day_of(closed).alias("day"), business_seconds(F.col("created_at"), closed, hours).alias("s"), kinds.alias("kinds")
    )
    return (
        timed.select("day", "s", F.inline("kinds"))
        .groupBy("day", "kind", "label", "detail")
        .agg(F.count("*").alias("count"), F.count("s").alias("timed"), F.sum("s").alias("seconds"))
    )


def write_partials(tickets: DataFrame, path: str, ingest_id: int, hours: WorkingHours = STANDARD_HOURS) -> None:
    """Write the partials of one ingest's tickets, in order of days; writing them again replaces them."""
    rows = daily_partials(tickets, hours).withColumn("ingest_id", F.lit(ingest_id).cast("bigint"))
    (
        rows.hint("rebalance", "kind")
        .sortWithinPartitions("kind", "ingest_id", "day")
        .write.partitionBy("kind", "ingest_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """All stored partials; ``read_ingested_partials`` leaves out those of unfinished ingests."""
    return spark.read.schema(PARTIALS).parquet(path)
