"""Connected components of a table of links, by alternating large and small stars.

Each step lets every node point its neighbours to the smallest it knows; the links of a step are
written before the next, and no node's neighbours are gathered in one place: the smallest
neighbour is an aggregate, and the join back to the links is one whose hot keys Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """links run from the larger node a to the smaller b."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    joined = links.join(least, "a")
    return joined.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; links: columns a and b; component: its least node."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links, before = stored(links), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = state
        links = stored(_small_star(_large_star(links).distinct()).distinct())
