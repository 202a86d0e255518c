"""Insert-if-absent and its accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketmill.functions.timecalc import STANDARD_HOURS, WorkingHours
from ticketmill.operators.partials import PARTIALS, write_partials
from ticketmill.session import staged
from ticketmill.sources.batches import parse_ticket_rows, split_ticket_rows
from ticketmill.sources.schemas import TICKET_KEY, TICKETS
from ticketmill.sources.tickets import LOADED, read_tickets, write_tickets


def known_keys(keys: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Those keys that the existing table already holds.

    A semi join on the batch's distinct ``keys``: when Spark finds them small enough
    to broadcast, the large table is only scanned for its key column, not shuffled.
    """
    return existing.select(key).join(keys.select(key), key, "left_semi")


def insert_if_absent(
    new: DataFrame, existing: DataFrame, key: str = TICKET_KEY, order_cols: Sequence[str] = ("batch_id", "pos")
) -> DataFrame:
    """Rows to append: the first row per key by ``order_cols``, if the key is not there yet.

    The key column is required, so rows without one are never inserted.

    ``rank = 1`` plans as a group limit before the shuffle, so a key that fills
    much of the batch leaves one row per task.
    """
    by_key = Window.partitionBy(key).orderBy(*order_cols)
    keyed = new.where(F.col(key).isNotNull())
    first = keyed.withColumn("_rank", F.row_number().over(by_key)).where("_rank = 1").drop("_rank")
    return first.join(known_keys(first, existing, key), key, "left_anti")


def tag_rows(
    rows: DataFrame, existing: DataFrame, key: str = TICKET_KEY, order_cols: Sequence[str] = ("batch_id", "pos")
) -> DataFrame:
    """Parsed rows with ``status``: ``inserted``, ``duplicate`` or ``skipped``.

    ``rows`` are read twice, so stage them first (``staged``). The join back
    uses the order columns, which are unique, so a frequent key spreads over
    all tasks.
    """
    valid = rows.where(F.col("error").isNull()).select(key, *order_cols)
    won = insert_if_absent(valid, existing, key, order_cols).select(*order_cols, F.lit(True).alias("_won"))
    status = (
        F.when(F.col("error").isNotNull(), F.lit("skipped"))
        .when(F.col("_won"), F.lit("inserted"))
        .otherwise(F.lit("duplicate"))
    )
    return rows.join(won, list(order_cols), "left").withColumn("status", status).drop("_won")


def ingest_report(tagged: DataFrame) -> DataFrame:
    """Counts of a tagged batch in one row; error texts stay in the tagged rows."""

    def how_many(status: str):
        return F.count_if(F.col("status") == status).alias(status)

    return tagged.agg(
        how_many("inserted"), how_many("skipped"), how_many("duplicate"), F.count("*").alias("total_processed")
    )


STORED = T.StructType([*TICKETS.fields, T.StructField("pos", T.LongType()), T.StructField("ingest_id", T.LongType())])
KEYS = T.StructType(
    [
        TICKETS[TICKET_KEY],
        T.StructField("tier", T.IntegerType()),
        T.StructField("grp", T.LongType()),
        T.StructField("key_bucket", T.IntegerType()),
        T.StructField("ingest_id", T.LongType()),
    ]
)
MERGES = "tier INT, below BIGINT"
COUNTS = "inserted BIGINT, skipped BIGINT, duplicate BIGINT, total_processed BIGINT, ingest_id BIGINT"

KEY_BUCKETS = 64
KEY_FAN = 16  # so many parts of the key table of one tier are merged into one of the next


def _key_bucket() -> Column:
    return F.pmod(F.xxhash64(TICKET_KEY), F.lit(KEY_BUCKETS)).cast("int").alias("key_bucket")


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table; empty before the first ingest."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_keys(keys: DataFrame, path: str) -> None:
    """Write rows of KEYS; the partitions at hand are replaced and all others stay."""
    parts = KEYS.fieldNames()[1:]
    (
        keys.hint("rebalance", "key_bucket", "ingest_id")
        .sortWithinPartitions(*parts, TICKET_KEY)
        .write.partitionBy(*parts)
        .option("partitionOverwriteMode", "dynamic")
        .option(f"parquet.bloom.filter.enabled#{TICKET_KEY}", "true")
        .mode("overwrite")
        .parquet(path)
    )


def merged_below(spark: SparkSession, path: str) -> list[int]:
    """For each tier of the key table the ingest id below which its parts live on in the next tier."""
    merges = _read_or_empty(spark, f"{path}_merges", MERGES).groupBy("tier").agg(F.max("below").alias("below"))
    return [row.below for row in merges.orderBy("tier").collect()]  # one row a tier


def _live(bounds: list[int]) -> Column:
    """True for the parts that hold: those that no merge has replaced and no unfinished merge has left."""
    tier, ingest_id = F.col("tier"), F.col("ingest_id")
    live = (tier == len(bounds)) & (ingest_id < bounds[-1] if bounds else F.lit(True))
    for t, below in enumerate(bounds):
        live = live | ((tier == t) & (ingest_id >= below) & (ingest_id < bounds[t - 1] if t else F.lit(True)))
    return live


def merge_keys(spark: SparkSession, base: str, fan: int = KEY_FAN) -> None:
    """Merge key files: ``fan`` parts of a tier become one part of the next, so an id is rewritten once a tier.

    Tier 0 has a part for each ingest, tier t one for ``fan ** t`` ingest ids, named by the last of them. Only
    parts of ingests before the last finished one are merged. A row in ``keys_merges``, written when the new
    parts are complete, makes them hold instead of the old ones, which are emptied then; stopped anywhere, the
    next merge goes on, and keys are neither lost nor doubled. It runs alone, as ingests do.
    """
    path = f"{base}/keys"
    upto = ingest_counts(spark, base).agg(F.max("ingest_id")).first()[0]
    tier, width = 0, fan
    while upto is not None and upto >= width:
        bounds = merged_below(spark, path)
        low, high = bounds[tier] if tier < len(bounds) else 0, upto // width * width
        if high > low:
            old = _read_or_empty(spark, path, KEYS).where(_live(bounds) & (F.col("tier") == tier) & (F.col("ingest_id") < high))
            part = F.call_function("div", F.col("ingest_id"), F.lit(width))
            group = F.call_function("div", part, F.lit(fan))
            moved = {"tier": F.lit(tier + 1), "grp": group, "ingest_id": (part + 1) * width - 1}
            write_keys(old.withColumns(moved).select(*KEYS.fieldNames()), path)
            spark.createDataFrame([(tier, high)], MERGES).coalesce(1).write.mode("append").parquet(f"{path}_merges")
        _empty_groups(spark, path, tier, max(low, high))
        upto, tier, width = max(low, high), tier + 1, width * fan


def _empty_groups(spark: SparkSession, path: str, tier: int, below: int) -> None:
    """Remove the files of a tier's groups that have been merged whole (at most the fan of a merge at a time, as a rule)."""
    stored = _read_or_empty(spark, path, KEYS).where(F.col("tier") == tier)
    gone = stored.groupBy("grp").agg(F.max("ingest_id").alias("last")).where(F.col("last") < below)
    none = spark.createDataFrame([], KEYS).drop("tier", "grp")
    for row in gone.collect():
        none.write.partitionBy("key_bucket", "ingest_id").option("partitionOverwriteMode", "static").mode("overwrite").parquet(
            f"{path}/tier={tier}/grp={row.grp}"
        )


def keys_before(rows: DataFrame, path: str, ingest_id: int) -> DataFrame:
    """Keys of earlier ingests in the buckets that these rows fall into.

    The key table holds nothing but keys, by hash bucket, so an ingest reads the
    buckets of its own keys (at most KEY_BUCKETS numbers go to the driver) and
    the Bloom filters of their files, not the tickets.
    """
    spark = rows.sparkSession
    buckets = [r.key_bucket for r in rows.where(F.col(TICKET_KEY).isNotNull()).select(_key_bucket()).distinct().collect()]
    stored = _read_or_empty(spark, path, KEYS)
    live = _live(merged_below(spark, path))
    return stored.where(F.col("key_bucket").isin(buckets) & (F.col("ingest_id") < ingest_id) & live).select(TICKET_KEY)


class UnfinishedIngestError(RuntimeError):
    """Another ingest has begun and not ended; it must be run again first."""


def begin_ingest(spark: SparkSession, base: str, ingest_id: int) -> None:
    """Note that an ingest begins; raise while another one that has begun has no row in ``counts``.

    An unfinished ingest may have stored tickets whose keys are not stored yet,
    so a later one could store these keys again. One writer at a time is assumed.
    """
    begun = _read_or_empty(spark, f"{base}/begun", "ingest_id BIGINT")
    bounds = merged_below(spark, f"{base}/keys")
    if bounds and ingest_id < bounds[0]:
        raise ValueError(f"the keys of ingest {ingest_id} of {base} have been merged; ids of new ingests must ascend")
    unfinished = begun.join(ingest_counts(spark, base).select("ingest_id"), "ingest_id", "left_anti")
    other = unfinished.where(F.col("ingest_id") != ingest_id).agg(F.min("ingest_id")).first()[0]
    if other is not None:
        raise UnfinishedIngestError(f"ingest {other} of {base} is not finished; run it again before ingest {ingest_id}")
    spark.range(1).select(F.lit(True).alias("begun")).write.mode("overwrite").parquet(f"{base}/begun/ingest_id={ingest_id}")


def finished(tickets: DataFrame, base: str) -> DataFrame:
    """Stored rows (with ``ingest_id``) of finished ingests, and those that no ingest brought.

    A semi join with the small table of finished ingests on a partition column:
    Spark reads only their folders where it broadcasts that table.
    """
    spark = tickets.sparkSession
    visible = ingest_counts(spark, base).select("ingest_id").unionByName(spark.range(1).select(F.lit(LOADED).cast("bigint").alias("ingest_id")))
    return tickets.join(visible, "ingest_id", "left_semi")


def read_ingested(spark: SparkSession, base: str, tz: str = "UTC", d_from=None, d_to=None) -> DataFrame:
    """The ticket table of the ingests below ``base``, as ``read_tickets``, without what an unfinished ingest has left."""
    return finished(read_tickets(spark, f"{base}/tickets", tz, d_from, d_to), base)


def read_ingested_partials(spark: SparkSession, base: str) -> DataFrame:
    """The daily partials of finished ingests, for the reports of ``plans/partials``."""
    return finished(_read_or_empty(spark, f"{base}/partials", PARTIALS), base)


def store_new_tickets(valid: DataFrame, base: str, ingest_id: int) -> DataFrame:
    """Store the tickets whose keys no earlier ingest has, and return them as stored; they are not visible yet."""
    spark = valid.sparkSession
    fresh = insert_if_absent(valid, keys_before(valid, f"{base}/keys", ingest_id), TICKET_KEY, ["pos"])
    write_tickets(fresh.select(*TICKETS.fieldNames(), "pos"), f"{base}/tickets", "replace", ingest_id)
    return _read_or_empty(spark, f"{base}/tickets", STORED).where(F.col("ingest_id") == ingest_id)


def finish_ingest(counts: DataFrame, base: str, ingest_id: int) -> None:
    """Write the ingest's row of ``counts``, which makes its tickets visible."""
    counts.write.mode("overwrite").parquet(f"{base}/counts/ingest_id={ingest_id}")


def ingest_lines(
    raw: DataFrame, base: str, ingest_id: int, tz: str = "UTC", hours: WorkingHours = STANDARD_HOURS, fan: int = KEY_FAN
) -> None:
    """Parse one batch (``pos``, ``line``) and store its new tickets, its bad rows and its counts.

    Below ``base``: ``tickets`` (the table that reports read), ``partials`` (the
    same by day and label, see ``plans/partials``), ``keys`` (``merge_keys``
    follows each ingest whose id ``fan`` divides), ``rejects``, ``counts``, and ``staging`` with the parsed rows of the running
    ingest alone, which the next one replaces. Each ingest owns its folders
    ``ingest_id=N`` and compares with earlier ones only. Running it again
    replaces those folders with the same rows, also after a partial write. The
    keys are written after the tickets and the counts last, so a row in
    ``counts`` says that an ingest is complete: ``read_ingested`` shows complete
    ingests only, and no other ingest begins (``begin_ingest``) until a stopped
    one has been run again.
    """
    begin_ingest(raw.sparkSession, base, ingest_id)
    rows = staged(parse_ticket_rows(raw.select("pos", "line"), tz), f"{base}/staging")
    valid, rejected = split_ticket_rows(rows)
    stored = store_new_tickets(valid, base, ingest_id)
    write_partials(stored, f"{base}/partials", ingest_id, hours)
    group = F.lit(ingest_id // fan).cast("bigint").alias("grp")
    write_keys(stored.select(TICKET_KEY, F.lit(0).alias("tier"), group, _key_bucket(), "ingest_id"), f"{base}/keys")
    rejected.write.mode("overwrite").parquet(f"{base}/rejects/ingest_id={ingest_id}")
    seen = rows.agg(F.count("*").alias("total_processed"), F.count_if(F.col("error").isNotNull()).alias("skipped"))
    inserted = F.lit(stored.count())
    duplicate = F.col("total_processed") - F.col("skipped") - inserted
    counts = seen.select(inserted.alias("inserted"), "skipped", duplicate.alias("duplicate"), "total_processed")
    finish_ingest(counts, base, ingest_id)
    if ingest_id % fan == 0:
        merge_keys(raw.sparkSession, base, fan)


def ingest_counts(spark: SparkSession, base: str) -> DataFrame:
    """One row for each complete ingest."""
    return _read_or_empty(spark, f"{base}/counts", COUNTS)
