"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

A rule rejects a text when its measure is over a cutoff. Cutoffs are chosen for each rule and
stratum (lang) from labelled texts that nothing else is learned from. For each cutoff of a fixed
ladder, from the mildest to the sharpest, the false rejections among n good labelled texts are
tested against the rule's share of RISK with the exact binomial tail P(Bin(n, risk) <= k). The
ladder is left at the first cutoff that fails (a fixed sequence needs no correction inside a
ladder); across rules and strata the level is divided by their number (Bonferroni). So with
confidence 1 - LEVEL no stratum loses more than RISK of its good texts to the rules. A rule
without enough labels in a stratum rejects nothing there.

Results for odd input: null, empty and blank texts have no words and fail the base rule of 50
words; a null lang is a stratum of its own; several labels of a doc_id count once, as good if any
is; repeated rows are judged alike; without labels only the base rules decide; a text's row does
not depend on other columns. Very long texts are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill.llm.common import stored

RISK = 0.05
LEVEL = 0.05
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

# Measures, with their cutoffs from the sharpest to the mildest.
RULES = {
    "symbols": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5],
    "exclamations": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8, 1.2, 1.8],
    "duplicate_lines": [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeated_words": [0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0, 100.0],
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, n_lines and the measure of every rule."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, BLANKS)) > 0)
    rows = rows.select(
        "doc_id",
        "lang",
        words.alias("words"),
        lines.alias("lines"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_exclamations"),
    )
    word = F.col("words")
    triple = F.transform(
        F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "word_chars",
        "n_symbols",
        "n_exclamations",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        triple.alias("triples"),
    )
    # only texts in which some three words repeat are put in order
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    ordered = F.when(some, F.array_sort(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered).drop("triples")
    row = F.col("ordered")
    again = F.filter(
        "ordered",
        lambda x, i: F.coalesce(F.get(row, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(row, i + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    rows = rows.withColumn("n_repeat_words", F.when(row.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")).drop("ordered")
    one = F.lit(1)
    return rows.withColumns(
        {
            "symbols": F.col("n_symbols") / F.greatest("word_chars", one),
            "exclamations": F.col("n_exclamations") / F.greatest("n_words", one),
            "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", one),
            "repeated_words": F.col("n_repeat_words") / F.greatest("n_words", one),
            "word_length": F.col("word_chars") / F.greatest("n_words", one),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term from logarithms; 1 where k is over the mean."""
    ratio, first = F.log(F.lit(p / (1 - p))), n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def add(have: Column, i: Column) -> Column:
        term = have["term"] + F.log((n - i + 1) / i) + ratio
        return F.struct(term.alias("term"), (have["total"] + F.exp(term)).alias("total"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, add, lambda x: x["total"]))


def _rung(rule: str) -> Column:
    """How many cutoffs of the rule's ladder the text's measure is over."""
    return F.size(F.filter(F.array(*map(F.lit, RULES[rule])), lambda t: F.col(rule) > t))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row for each stratum: lang and for each rule the lowest rung that rejects (null: none does)."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("quality").alias("quality")).filter("quality = 1")
    # texts that the base rules reject anyway are no loss of the rules
    good = rows.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("labelled"))
    rungs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _rung(r).alias("rung")) for r in RULES]))
    counts = good.select("lang", rungs.alias("at")).groupBy("lang", "at.rule", "at.rung").count()
    ladder = F.explode(F.sequence(F.lit(0), F.lit(max(map(len, RULES.values())))))
    every = counts.select("lang", "rule").distinct().withColumn("rung", ladder)
    same = F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule")) & (F.col("a.rung") == F.col("b.rung"))
    counts = every.alias("a").join(counts.alias("b"), same, "left").select("a.lang", "a.rule", "a.rung", F.coalesce("count", F.lit(0)).alias("count"))
    down = Window.partitionBy("lang", "rule").orderBy(F.desc("rung"))
    whole = Window.partitionBy("lang", "rule")
    tests = counts.select("lang", "rule", "rung", F.sum("count").over(down).alias("k"), F.sum("count").over(whole).alias("n")).filter("rung > 0")
    families = F.size(F.collect_set(F.struct("lang", "rule")).over(Window.partitionBy()))
    passed = binomial_tail(F.col("n").cast("double"), F.col("k"), risk / len(RULES)) <= F.lit(level) / F.col("families")
    tests = tests.withColumn("families", families).withColumn("passed", passed)
    # the sequence ends at the first rung, from the mildest, that fails
    tests = tests.withColumn("open", F.min(F.col("passed").cast("int")).over(down))
    return tests.groupBy("lang").pivot("rule", list(RULES)).agg(F.min(F.when(F.col("open") == 1, F.col("rung"))))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Per document the base counts, base_failed, kept, and the rules that reject it."""
    rows = stored(measured(docs))
    chosen = cutoffs(rows, labels, risk, level)
    chosen = chosen.select(F.col("lang").alias("stratum"), *[F.col(r).alias(f"{r}_rung") for r in RULES])
    judged = rows.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.concat_ws(",", *[F.when(_rung(r) >= F.col(f"{r}_rung"), F.lit(r)) for r in RULES])
    return judged.withColumn("rejected_by", rejected).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"),
        "rejected_by",
    )
