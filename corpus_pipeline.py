"""The corpus pipeline: documents through five stages, each written and read again before the next.

Every stage is one operator of ticketmill.llm over all rows that the stage before kept. The first
four return the columns of documents; the last adds size, source_size, target and taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.llm.common import read_table, stored
from ticketmill.llm.contamination import without_contaminated
from ticketmill.llm.linededup import ADDED, dedup_lines
from ticketmill.llm.mixing import mixed_documents
from ticketmill.llm.simhash import keep_one
from ticketmill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a text may end empty, and n_chars follows the text.

    Columns with names that the operator returns are kept as they are.
    """
    own = {x: f"{x}_{uuid.uuid4().hex}" for x in ADDED if x in docs.columns}
    kept = dedup_lines(docs.withColumnsRenamed(own))
    n_chars = F.when(kept["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n_chars).drop(*ADDED).withColumnsRenamed({y: x for x, y in own.items()}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words that it takes of each."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the learned scores nor SimHash; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stored(docs) if number else docs, sf_dir)
    return docs
