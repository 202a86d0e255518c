"""Export of tickets as nested documents, one JSON object per line."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.functions.text import iso_text
from ticketmill.functions.timecalc import utc_now, wall_clock_value
from ticketmill.operators.filters import check_limit, closed_since
from ticketmill.sources.schemas import TICKET_KEY


def parse_since(since: str | datetime | None, days: int | None = None, now: datetime | None = None, tz: str = "UTC") -> datetime:
    """Lower bound of an export as wall-clock time: ``since``, or ``days`` before ``now``. One must be given."""
    if (not since) == (days is None):
        raise ValueError("give either since or days")
    if not since:
        return wall_clock_value(now or utc_now(), tz) - timedelta(days=days)
    if isinstance(since, str):
        since = datetime.fromisoformat(since.replace("Z", ""))
    return wall_clock_value(since, tz)


def _document_columns(offset: str):
    # Section headings of the document text.
    sections = (("[Asunto]", "subject"), ("[Descripción]", "content"), ("[Resolución]", "resolution"))
    blocks = [F.concat(F.lit(head + "\n"), F.coalesce(F.col(c), F.lit(""))) for head, c in sections]
    # The metadata keys and their order.
    metadata = F.struct(
        iso_text(F.col("created_at"), offset).alias("created_at"),
        iso_text(F.col("closed_at"), offset).alias("closed_at"),
        "source",
        "category",
        "subcategory",
        "itinerary_number",
        "case_key",
        "owner_id",
        "owner_name",
    )
    return F.col(TICKET_KEY).alias("id"), F.concat_ws("\n\n", *blocks).alias("text"), metadata.alias("metadata")


def export_documents(
    tickets: DataFrame,
    since: str | datetime | None = None,
    limit: int | None = None,
    days: int | None = None,
    now: datetime | None = None,
    tz: str = "UTC",
    offset: str = "+00:00",
) -> DataFrame:
    """Documents closed since an instant or in the last ``days``, newest first.

    With a limit this is a top-k: each task keeps ``limit`` rows. Without one
    rows are range-partitioned by closing time and id, so that
    files come out in order and a busy instant can still be split.
    """
    recent = closed_since(tickets, parse_since(since, days, now, tz))
    newest = [F.col("closed_at").desc(), F.col(TICKET_KEY).asc()]
    if limit is None:
        ordered = recent.repartitionByRange(*newest).sortWithinPartitions(*newest)
    else:
        ordered = recent.orderBy(*newest).limit(check_limit(limit))
    return ordered.select(*_document_columns(offset))


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write documents as NDJSON files; NULL metadata stays as explicit null."""
    documents.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of written documents (``line``) in file order: by part number, place of the split, and row."""
    rows = spark.read.text(path).select("value", "_metadata.file_name", "_metadata.file_block_start")
    rows = rows.withColumns({"_part": F.regexp_extract("file_name", r"part-(\d+)", 1).cast("int"), "_at": F.monotonically_increasing_id()})
    return rows.orderBy("_part", "file_block_start", "_at").select(F.col("value").alias("line"))
