"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by its quality weight: -ln(u) / weight, with u from
a hash of doc_id, so reruns agree. Within its source, documents are taken in order of their keys
up to the source's token budget. A budget of more than the source holds takes complete epochs
first, and the rest as one fractional epoch.

Prefix sums without gathering a source in one task: the key's distribution 1 - exp(-key) is cut
into RANGES equal ranges. Sizes are summed per source and range, the sums of whole ranges are
accumulated, and only the documents of the one range in which a source's budget ends are put in
order, 1 / RANGES of the source.

Results for odd input: null, empty and blank texts have size 0 and take 0; very long texts
count whole; a null source is a source, last in order; equal keys go by doc_id and then size, so repeated rows are separate
documents; sources without words have target 0; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill.llm.common import row_id, stored

SHARES = (5, 2, 1)
TOTAL = 1.5
MOST = 2
RANGES = 4096
SEED = 1_000_003
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    """Words of anything but spaces and the controls from tab to carriage return."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: texts with many symbols among their characters weigh less."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * F.least(F.lit(1.0), F.lit(4.0) * symbols / F.greatest(length, F.lit(1))), F.lit(1.0))


def targets(sizes: DataFrame, shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """source, source_size and target: shares of `total` times all sizes, none above `most` times its source.

    sizes: one row for each source (source, source_size). Sources are filled in the order in which
    they reach their limit; those that do are set to it, and the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, shares)), ((F.row_number().over(order) - 1) % len(shares) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    # the first source that its share does not fill sets the level for all from it on
    free = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level"))
    rows = rows.withColumn("free", F.first(free, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("free").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("free") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(rows: DataFrame, shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for rows of doc_id, source, size and weight.

    The document at which a budget ends gives the words that are left of it.
    """
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.select("doc_id", "source", "size", (-F.log(u) / F.col("weight")).alias("key"))
    rows = stored(rows.withColumn("range", F.least(F.lit(RANGES - 1), F.floor((1 - F.exp(-F.col("key"))) * RANGES)).cast("int")))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    totals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), shares, total, most).withColumnRenamed("source", "named")
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        ranges.join(totals, F.col("source").eqNullSafe(F.col("named")))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("room", F.col("rest") - F.coalesce(F.sum("range_size").over(along), F.lit(0)))
    )
    plan = plan.select(F.col("source").alias("of"), F.col("range").alias("in_range"), "range_size", "source_size", "target", "epochs", "room")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range"))).drop("of", "in_range")
    split = (F.col("room") > 0) & (F.col("room") < F.col("range_size"))
    taken = F.col("epochs") * F.col("size")
    whole = joined.filter(~split).withColumn("taken", taken + F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = joined.filter(split).withColumn("taken", taken + F.greatest(F.lit(0), F.least(left, F.col("size"))))
    columns = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source"]
    return whole.select(columns).unionByName(part.select(columns))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix of a table of documents by their words; options as for mix()."""
    size, weight = word_count(F.col("text")), quality_weight(F.col("text"))
    return mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), weight.alias("weight")), **options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes words from, with all their columns and size, source_size, target and taken."""
    names = ["size", "source_size", "target", "taken"]
    plan = mix_documents(docs.select(row_id().alias("doc_id"), "text", "source"), **options)
    plan = plan.filter("taken > 0").select(F.col("doc_id").alias("taken_id_"), *names).dropDuplicates(["taken_id_"])
    rows = docs.drop(*names).withColumn("row_id_", row_id())
    return rows.join(plan, F.col("row_id_") == F.col("taken_id_")).drop("row_id_", "taken_id_")
