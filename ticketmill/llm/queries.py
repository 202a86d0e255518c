"""The registered queries over the document tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketmill.llm import oracles
from ticketmill.llm.classlm import class_scores
from ticketmill.llm.common import read_table
from ticketmill.llm.contamination import decontaminate
from ticketmill.llm.disclosure import private_spans
from ticketmill.llm.licenses import license_scan
from ticketmill.llm.linededup import line_dedup
from ticketmill.llm.mixing import mix_documents
from ticketmill.llm.periodicity import periodic_runs
from ticketmill.llm.quality import quality_verdicts
from ticketmill.llm.simhash import simhash_dedup
from ticketmill.llm.substring import substring_dedup
from ticketmill.llm.suffix import suffix_dedup
from ticketmill.llm.toxicity import toxicity_scores
from ticketmill.llm.variants import spelling_variants


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_class_lm": op10_class_lm,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_private_spans": op12_private_spans,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING,
    "op11_spelling_variants": oracles.VARIANTS,
}
