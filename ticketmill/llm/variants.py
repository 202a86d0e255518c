"""Spelling variant grouping: words one edit apart, found by composing finite-state machines.

The vocabulary is a table of words and their counts. A minimised acceptor of words, a transducer
that inserts, deletes or replaces one code point, and the acceptor again are composed; the
composition accepts the pairs of near words. It is enumerated partition by partition, each with
the initial state that a common part of its words leads to. A pair whose shorter word has m code
points, h = m div 2, agrees in its first h or its last m - h of them. So a word of length L goes,
for m = L and m = L - 1, into the partition of its first h and into that of its last m - h code
points; what remains of it, its window, is what the partition's acceptor holds. A pair with both
parts in common counts in the first. Partitions of over LIMIT words, and of windows of over LONG
code points, are partitioned again in the same way by their windows, until windows of two code
points are left, so a beginning that a third of all words share is split, and no pair is lost.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that
is RATIO times its own or more. Forms are followed to their last by doubling steps; their number
follows from the largest count, as each form counts RATIO times what comes before it.

Results for odd input: null texts have no words; a null doc_id leaves the query's words as they
are; runs of letters of any length are whole words, also in very long texts; repeated rows count
each; words without a near word are their own root; an empty table gives no rows; other columns
of the documents are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
LIMIT = 20_000
LONG = 64
BUCKET_ROWS = 200_000

Pair = tuple[str, str]


class Acceptor:
    """The minimal deterministic acceptor of some words, and its composition with one edit."""

    def __init__(self, words: list[str]):
        """words: distinct, in code-point order."""
        self.words = words
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self._states: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {}
        self._edited: dict[int, list[Pair]] = {}
        self.start = self._state(0, len(words), 0)

    def _state(self, first: int, end: int, depth: int) -> int:
        """The state that accepts what follows `depth` equal code points of words[first:end]; equal states are one."""
        words = self.words
        final = len(words[first]) == depth
        arcs, at = {}, first + final
        while at < end:
            symbol, upto = words[at][depth], at + 1
            while upto < end and words[upto][depth] == symbol:
                upto += 1
            arcs[symbol] = self._state(at, upto, depth + 1)
            at = upto
        kind = (final, *arcs.items())
        if kind not in self._states:
            self._states[kind] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return self._states[kind]

    def common(self, p: int, q: int) -> list[str]:
        """The strings that both states accept."""
        key = (p, q) if p < q else (q, p)
        found = self._common.get(key)
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            one, other = self.arcs[p], self.arcs[q]
            if len(other) < len(one):
                one, other = other, one
            for symbol, to in one.items():
                if symbol in other:
                    found += [symbol + x for x in self.common(to, other[symbol])]
            self._common[key] = found
        return found

    def edited(self, q: int) -> list[Pair]:
        """Pairs of strings accepted by q, one edit apart: replaced in the order of code points, or the longer first."""
        found = self._edited.get(q)
        if found is None:
            arcs = sorted(self.arcs[q].items())
            found = [(a + x, a + y) for a, to in arcs for x, y in self.edited(to)]
            for i, (a, to) in enumerate(arcs):
                for b, other in arcs[i + 1 :]:
                    found += [(a + x, b + x) for x in self.common(to, other)]
                # of equal symbols in a row the last one is what goes, so a pair is accepted once
                found += [(a + x, x) for x in self.common(to, q) if not x.startswith(a)]
            self._edited[q] = found
        return found

    def pairs(self) -> list[Pair]:
        return self.edited(self.start)


def near_windows(windows: list[str], least: int, ends_apart: bool) -> list[Pair]:
    """Near pairs of a partition's windows whose shorter one has `least` code points.

    With ends_apart, pairs that differ in a last code point alone are left out: they count elsewhere.
    """
    found = Acceptor(sorted(windows)).pairs()
    return [(x, y) for x, y in found if min(len(x), len(y)) == least and not (ends_apart and x[:-1] == y)]


ROWS = "key string, window string, least int, ends_apart boolean, word string, n long"


def _partitioned(rows: DataFrame) -> DataFrame:
    """Each row once for every partition that its window falls into; a part of a partition has the pairs of its `least` alone."""
    length = F.length("window")
    lengths = F.when(F.col("least").isNotNull(), F.array("least")).when(length > 0, F.array(length, length - 1))
    m = F.explode(lengths.otherwise(F.array(length))).alias("m")
    rows = rows.select("*", m).withColumn("h", F.floor(F.col("m") / 2).cast("int"))
    rest = F.col("m") - F.col("h")

    def side(name: str, part: Column, window: Column, least: Column, ends_apart: Column) -> Column:
        key = F.concat("key", F.lit("|"), F.col("m").cast("string"), F.lit(name), part)
        return F.struct(key.alias("key"), window.alias("window"), least.cast("int").alias("least"), ends_apart.alias("ends_apart"))

    end = F.length("window")
    first = side("<", F.expr("substring(window, 1, h)"), F.expr("substring(window, h + 1)"), rest, F.col("ends_apart"))
    last = side(">", F.substring("window", end - rest + 1, rest), F.substring("window", F.lit(1), end - rest), F.col("h"), F.lit(True))
    # without a first half, the first partition has all pairs
    sides = F.explode(F.when(F.col("h") > 0, F.array(first, last)).otherwise(F.array(first))).alias("side")
    return rows.select(sides, "word", "n").select("side.*", "word", "n")


NEAR = "word string, n_near long, best_n long, best string"
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near_of_bucket(table: pa.Table) -> pa.Table:
    """For each word of a bucket's partitions: the number of its near words there, and the most frequent of them."""
    key = table.column("key").combine_chunks().dictionary_encode()
    key = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key
    codes = key.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    size = np.bincount(codes)
    order = order[size[codes[order]] > 1]
    table = table.take(pa.array(order))
    windows, words, counts = (table.column(x).to_pylist() for x in ("window", "word", "n"))
    least, apart = (table.column(x).to_pylist() for x in ("least", "ends_apart"))
    best: dict[str, tuple[int, int, str]] = {}
    for s, e in c.run_bounds(codes[order]):
        at = {windows[i]: i for i in range(s, e)}
        for x, y in near_windows(windows[s:e], least[s], apart[s]):
            i, j = at[x], at[y]
            for own, other in ((i, j), (j, i)):
                now = (1, -counts[other], words[other])
                had = best.get(words[own])
                best[words[own]] = now if had is None else (had[0] + 1, *min(had[1:], now[1:]))
    rows = [(w, k, -n, x) for w, (k, n, x) in best.items()]
    return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _NEAR, strict=True)], schema=_NEAR) if rows else _NEAR.empty_table()


def near_words(words: DataFrame, limit: int = LIMIT, longest: int = LONG) -> DataFrame:
    """For the distinct words (word, n) that have near words: n_near, and best with best_n, the most frequent of them."""
    spark = words.sparkSession
    start = words.select(F.lit("").alias("key"), F.col("word").alias("window"), F.lit(None).cast("int").alias("least"), F.lit(False).alias("ends_apart"), "word", "n")
    rows, parts = _partitioned(start), []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.length("window")).alias("longest"))
        again = (F.col("size") > limit) & (F.col("longest") > 2) | (F.col("size") > 1) & (F.col("longest") > longest)
        hot = c.stored(sizes.where(again).select("key"))
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti"))
        rows = c.stored(_partitioned(rows.join(hot, "key", "left_semi")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * words.count() / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int").alias("bucket")
    found = whole.select("*", bucket).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_near_of_bucket, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def with_roots(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """word and root for words that have a form (word, form), where a form counts `ratio` times its word or more."""
    steps = max(1, math.floor(math.log(max(largest, ratio), ratio)) + 1)
    roots = c.stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = c.stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return roots


def variant_groups(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT, longest: int = LONG) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct words and their counts (word, n)."""
    words = c.stored(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, limit, longest)
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = c.stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        )
    )
    largest = words.agg(F.max("n")).first()[0] or 0
    roots = with_roots(known.where("form IS NOT NULL").select("word", "form"), largest, ratio)
    rooted = known.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The distinct words (column word) of enough code points and occurrences, with their counts n."""
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def letter_runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id and word for each run of letters, of `least` code points or more, with A to Z in lower case."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{least},}}"), 0)).alias("run")
    return docs.select("doc_id", run).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))


def with_slips(words: DataFrame) -> DataFrame:
    """The query's words: where 31 divides h, the crc32 of `doc_id:word`, the code point numbered h mod length is deleted."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary"))
    words = words.select("word", h.alias("h")).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
    slip = F.expr("concat(substring(word, 1, at), substring(word, at + 2))")
    return words.select(F.when(F.col("h") % 31 == 0, slip).otherwise(F.col("word")).alias("word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word of the documents (runs of letters with the query's slips): form, root, n, n_near and form_n."""
    return variant_groups(vocabulary(with_slips(letter_runs(docs, MIN_LENGTH))))
