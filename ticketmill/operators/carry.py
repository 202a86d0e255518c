"""Last known value before each row, for logs with very long histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPAN = 1 << 16
BLOCK = "_block"


def in_blocks(log: DataFrame, order: str, span: int = DEFAULT_SPAN, block: str = BLOCK) -> DataFrame:
    """Number the blocks of ``span`` order values; ``order`` is a BIGINT."""
    return log.withColumn(block, F.call_function("div", F.col(order), F.lit(span).cast("bigint")))


def carry_forward(
    rows: DataFrame,
    key: str,
    order: str,
    columns: Sequence[str],
    span: int = DEFAULT_SPAN,
    block: str = BLOCK,
    prefix: str = "prior_",
    levels: int = 2,
) -> DataFrame:
    """Add, for each column, its last non-NULL value in earlier rows of the same key.

    ``rows`` come from ``in_blocks`` and ``order`` is unique within a key. One
    plain window per key would put a whole history into one task. Here a window
    covers one block, at most ``span`` rows, and one summary row per block takes
    values from block to block. The summaries are carried in the same way, in
    blocks of blocks, so that also sparse order values (such as times) leave few
    rows for the last window. Blocks of rows stay in place for a second pass.
    """
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"last_{c}") for c in columns]
    blocks = rows.groupBy(key, block).agg(*latest)
    carried = [f"last_{c}" for c in columns]
    if levels > 1:
        upper = f"{block}_up"
        blocks = carry_forward(in_blocks(blocks, block, span, upper), key, block, carried, span, upper, "in_", levels - 1)
    else:
        earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumns({f"in_{c}": F.last(c, ignorenulls=True).over(earlier) for c in carried})
    blocks = blocks.select(key, block, *[f"in_{c}" for c in carried])

    earlier_rows = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = [
        F.coalesce(F.last(c, ignorenulls=True).over(earlier_rows), F.col(f"in_last_{c}")).alias(f"{prefix}{c}")
        for c in columns
    ]
    return rows.join(blocks, [key, block], "left").select(*rows.columns, *known)


def running_total(
    rows: DataFrame,
    key: str,
    order: str,
    value: str,
    name: str,
    span: int = DEFAULT_SPAN,
    block: str = BLOCK,
    levels: int = 2,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the same key, block by block as in ``carry_forward``."""
    totals = rows.groupBy(key, block).agg(F.sum(value).alias("_total"))
    if levels > 1:
        upper = f"{block}_up"
        totals = running_total(in_blocks(totals, block, span, upper), key, block, "_total", "_before", span, upper, levels - 1)
    else:
        earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    earlier_rows = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(value).over(earlier_rows), F.lit(0))
    return rows.join(totals.select(key, block, "_before"), [key, block]).select(*rows.columns, before.alias(name))
