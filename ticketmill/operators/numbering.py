"""Numbers for the rows of an ordered result, counted partition by partition."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.session import scratch_path, staged

_LOCAL_BITS = 33  # fixed value: monotonically_increasing_id holds the partition above this many bits


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """The rows with their place (from 1) in the order in which they come out, such as that of ``orderBy``.

    Partitions are in order one after another, so a row's place is its place in
    its partition and the sizes of the partitions before it. The rows are stored
    once with both; only the sizes, one number for each partition, go to the
    driver and back, and no task sees more rows than it had.
    """
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()
    placed = rows.withColumn("_at", at)
    placed = placed.withColumns({"_part": F.shiftright("_at", _LOCAL_BITS).cast("int"), "_at": F.col("_at") % (1 << _LOCAL_BITS)})
    placed = staged(placed, scratch_path(spark, "numbered"))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(part, n) for (part, _), n in zip(sizes, before, strict=False)], "_part INT, _before BIGINT")
    whole = placed.join(offsets, "_part")
    return whole.withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_at", "_part", "_before")


def numbered_first(rows: DataFrame, name: str = "position") -> DataFrame:
    """As ``numbered``, for the first rows of an order (``orderBy`` and ``limit``), which Spark returns in one partition."""
    return rows.coalesce(1).withColumn(name, F.monotonically_increasing_id() + 1)
