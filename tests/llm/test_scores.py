import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_dedup import by_order, rows_of
from ticketmill.llm import classlm, licenses, quality, toxicity
from ticketmill.llm.common import read_table, stored

SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


def within_one_edit(term, word):
    """Insertions, deletions and substitutions after the first letter, or a swap of neighbours."""
    letters = set(word + term)
    near = {term}
    near |= {term[:i] + term[i + 1 :] for i in range(1, len(term))}
    near |= {term[:i] + x + term[i + 1 :] for i in range(1, len(term)) for x in letters}
    near |= {term[:i] + x + term[i:] for i in range(1, len(term) + 1) for x in letters}
    near |= {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    return word in near


def test_matcher_equals_one_edit_by_enumeration():
    rng = random.Random(3)
    terms = ["abcab", "bacca", "cabbage", "abc"]
    matcher = toxicity.Matcher(terms, [])
    for _ in range(4000):
        word = "".join(rng.choice("abcge") for _ in range(rng.randint(1, 8)))
        exact = word in terms
        near = any(within_one_edit(t, word) for t in terms if len(t) >= 5)
        assert matcher.edits(word) == (0 if exact else 1 if near else -1), word


def distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, by the full table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_matcher_equals_edit_distance_at_any_letter():
    rng = random.Random(4)
    terms = ["abcab", "bacca", "cabbage", "abc", "abcgeabcg"]
    matcher = toxicity.Matcher(terms, [], first=True)
    words = {"".join(rng.choice("abcge") for _ in range(rng.randint(1, 8))) for _ in range(2000)}
    for term in terms * 200:
        word = list(term)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word))
            word[i : i + 2] = rng.choice([word[i + 1 : i + 2], ["a", *word[i + 1 : i + 2]], ["g", *word[i : i + 2]], word[i : i + 2][::-1]])
        words.add("".join(word))
    for word in words:
        near = [d for t in terms if (d := distance(t, word)) <= toxicity.edits_allowed(len(t), False)]
        assert matcher.edits(word) == min(near, default=-1), word


def test_lost_and_changed_first_letters_and_forms_of_stems(spark):
    forms = ["grolak", "grolaken", "grolaks", "grolakish", "grolaker"]
    rows = [(i, f"word{i} more of it {forms[i % 5]} here" if i % 2 else f"word{i} more of it all here", i % 2) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(train, train)
    assert any("grolak".startswith(s) for s in model.stems)
    matcher = model.matcher()
    for word in ("grolak", "golak", "xrolak", "$rolak", "grolka", "gorlaken", "grlaks"):
        assert toxicity.hits(f"you {word} there", matcher)[1] == 1, word
    scores = toxicity.toxicity_scores(spark.createDataFrame([(1, "you rolak there")], "doc_id long, text string").unionByName(train.select("doc_id", "text")), train)
    assert scores.filter("n_misspelled = 1").count() == 1


def test_usual_words_are_no_misspellings():
    matcher = toxicity.Matcher(["loser"], [], first=True, usual=["closer", "loser"])
    assert [matcher.edits(w) for w in ("closer", "loser", "oser", "looser")] == [-1, 0, 1, 1]


def test_stems_match_beginnings_and_long_ones_with_an_edit():
    matcher = toxicity.Matcher([], ["lowei", "abcdefg"])
    assert [matcher.edits(w) for w in ("lowei", "loweischaft", "lwei", "abcdefgxyz", "abcdfgxyz")] == [0, 0, -1, 0, 1]


def test_quoted_hits_weigh_less():
    matcher = toxicity.Matcher(["moron"], [])
    assert toxicity.hits("you moron", matcher)[4] == 1.0
    assert toxicity.hits('the "moron" of the play', matcher)[4] == toxicity.QUOTED
    assert toxicity.hits("the word moron", matcher)[4] == toxicity.QUOTED


def test_nested_terms_leave_the_longest():
    counts = [("lose", True, 100), ("loser", True, 100), ("loser", False, 99), ("lowei", True, 50), ("loweia", True, 20), ("loweiab", False, 20)]
    assert toxicity.choose_terms(counts) == (["loser"], ["lowei"])


@tables
def test_toxicity_on_held_out_labels(spark):
    docs, labels = read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, int(i in (1, 2, 10)), 1) for i in range(1, 18)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.toxicity_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.toxicity_scores(nothing, labels).collect() == []


def test_license_base_phrases_equal_brute_force(odd):
    got = licenses.license_scan(odd).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert by_order(got) == by_order((i, *brute.base_phrases(t)) for i, t in rows_of(odd))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("distributed under the terms of the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("BSD 3-Clause License", "bsd-3-clause"),
        ("a BSD-style license", "bsd"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
        ("CC BY-NC-ND 4.0", "cc-by,cc-by-nc-nd"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("ALL RIGHTS RESERVED", "reserved"),
        ("Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
        ("the BigScience OpenRAIL-M license", "openrail"),
        ("mit Freunden", ""),
        ("", ""),
    ],
)
def test_license_labels(text, labels):
    assert licenses.scan(text.encode())[5] == labels


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
        ("GNU Affero General Public License v3", "agpl-3.0,gpl"),
        ("GNU Library General Public License version 2", "gpl,lgpl-2.0"),
        ("GNU Lesser General Public License v3", "gpl,lgpl-3.0"),
        ("GNU General Public License v3 and, for parts, the GNU Lesser General Public License v3", "gpl,gpl-3.0,lgpl-3.0"),
        ("Licensed under GPLv3 or later", "gpl-3.0"),
        ("LGPLv2.1", "lgpl-2.1"),
        ("AGPLv3", "agpl-3.0"),
        ("MPLv2", "mpl-2.0"),
        ("an MIT-licensed library", "mit"),
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "gpl,gpl-2.0",
        ),
        (
            "under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\n"
            "version 2.1 of the License, or (at your option) any later version.",
            "gpl,lgpl-2.1",
        ),
        ("the general manager of a public house commits to nothing", ""),
    ],
)
def test_license_texts_written_by_hand(text, labels):
    assert licenses.scan(text.encode())[5] == labels


def test_contained_detections_are_suppressed():
    rules = [r.label for _, _, r in licenses.detections(" the new bsd license and a bsd license ", {"bsd"})]
    assert rules == ["bsd-3-clause", "bsd"]


def written(items):
    """All texts that a parsed expression matches; one character stands for its range."""
    out = [""]
    for op, value in items:
        match str(op):
            case "LITERAL":
                ways = [chr(value)]
            case "IN":
                ways = [chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else "7" for o, v in value]
            case "MAX_REPEAT":
                ways = [x for n in range(value[0], value[1] + 1) for x in ([""] if n == 0 else written([*value[2]] * n))]
            case "SUBPATTERN":
                ways = written(value[3])
            case "BRANCH":
                ways = [x for branch in value[1] for x in written(branch)]
            case "ASSERT":
                ways = [""]
        out = [a + b for a in out for b in ways]
    return out


def test_each_alternative_of_each_rule_holds_a_keyword():
    for rule in licenses.RULES:
        for text in written(re._parser.parse(rule.pattern.pattern)):
            assert rule.pattern.search(f" {text} "), (rule.label, text)
            assert not rule.keywords.isdisjoint(text.split()), (rule.label, text)


def test_scans_with_and_without_the_gate_are_equal():
    for rule in licenses.RULES:
        texts = written(re._parser.parse(rule.pattern.pattern))
        for text in texts[:: max(1, len(texts) // 8)]:
            joined = f" some {text} here "
            assert licenses.detections(joined, licenses.KEYWORDS.intersection(joined.split())) == licenses.detections(joined, licenses.KEYWORDS)


def test_there_are_hundreds_of_rules():
    assert len(licenses.RULES) >= 400


def test_empty_license_scan(nothing):
    assert licenses.license_scan(nothing).collect() == []


def test_quality_counts_equal_brute_force(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.quality_verdicts(odd, labels)
    assert by_order(got.select("doc_id", *names).collect()) == by_order((i, *brute.quality_counts(t)) for i, t in rows_of(odd))
    assert all(r.kept == (not r.base_failed) for r in got.collect())


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for n in (1, 10, 200, 3000) for k in (0, 1, 5, 19) for p in (0.01, 0.05)]
    for n, k, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(float(n)), F.lit(k).cast("long"), p)).first()[0]
        assert got == pytest.approx(1.0 if k >= n * p else brute.binomial_tail(n, k, p), rel=1e-9)


def test_cutoffs_keep_their_risk(spark):
    """2,000 good texts, none with symbols and 300 with many repeats: one rule opens and the other stays mild."""
    rows = []
    for i in range(2000):
        rows.append((i, "en", 0.0, 0.0, 0.0, 0.47 if i < 300 else 0.01, 5.0, False))
    measures = spark.createDataFrame(rows, "doc_id long, lang string, symbols double, exclamations double, duplicate_lines double, repeated_words double, word_length double, base_failed boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    row = quality.cutoffs(stored(measures), labels).first()
    assert row.symbols == 1 and row.duplicate_lines == 1 and row.repeated_words is None


@tables
def test_quality_rejects_few_good_texts(spark):
    docs, labels = read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels")
    rows = quality.quality_verdicts(docs, labels).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed").collect()
    assert sum(not r.kept for r in rows) <= 0.05 * len(rows)


def test_empty_quality(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_verdicts(nothing, labels).collect() == []


def base_of(rows):
    texts = [(i, [*brute.words(brute.lowered(t)), "\n"]) for i, t in rows]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(x for i, w in texts if not out(i) for x in w)
    n, v = sum(count.values()), len(count)
    return [(i, out(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in texts]


def test_base_scores_equal_brute_force(odd):
    got = classlm.class_scores(odd).collect()
    assert by_order((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == by_order(base_of(rows_of(odd)))
    assert all(r.score < 0 for r in got)


@tables
def test_class_model_beats_unigrams_on_held_out_texts(spark):
    rows = classlm.class_scores(read_table(spark, SF_DIR, "documents")).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_class_model_without_training_texts(spark, nothing):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert all(r.score == pytest.approx(r.base_score) for r in classlm.class_scores(docs).collect())
    assert classlm.class_scores(nothing).collect() == []


def likelihood(pairs, own, k):
    member = np.eye(k)[own]
    table = member.T @ pairs @ member
    f = classlm._xlogx
    return f(table).sum() - f(table.sum(axis=0)).sum() - f(table.sum(axis=1)).sum()


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    truth = np.arange(30) % 3
    pairs = np.where((truth[:, None] + 1) % 3 == truth[None, :], rng.poisson(30, (30, 30)), rng.poisson(1, (30, 30))).astype(float)
    start = np.empty(30, int)
    start[np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")] = np.arange(30) % 3
    own = classlm.exchange(pairs, 3, 20)
    assert likelihood(pairs, own, 3) >= likelihood(pairs, start, 3)
    assert len({(a, b) for a, b in zip(truth, own, strict=True)}) == 3


def class_texts(spark, n=60, ending=""):
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{j}{ending}" for j in range(12)] for k in "abc"]
    texts = [" ".join(kinds[j % 3][int(rng.integers(12))] for j in range(int(rng.integers(3, 40)))) for _ in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def hash_of(word):
    if word == "\n":
        return int(classlm.END)
    data = np.frombuffer(word.encode(), np.uint8)
    return int(classlm.c.word_hashes(data, np.zeros(1, np.int64))[0])


def fitted(docs, classes, sweeps, rise=0.0):
    chunks = classlm.c.stored(classlm.chunks_of(docs))
    model, classed, history = classlm.fit(chunks, 4, classes, sweeps, rise)
    known = {}
    for r in classed.collect():
        columns = (np.frombuffer(r[x], t).tolist() for x, t in (("words", np.uint64), ("counts", np.int64), ("classes", np.uint8)))
        known |= {w: (n, k) for w, n, k in zip(*columns, strict=True)}
    return model, known, history


def test_every_word_has_a_class_and_sweeps_raise_the_likelihood(spark, monkeypatch):
    # all but four words begin in the class of their common ending
    monkeypatch.setattr(classlm.frequent_words, "__defaults__", (4,))
    texts, docs = class_texts(spark, ending="same")
    model, known, history = fitted(docs, 4, 5)
    train = [[*t.split(), "\n"] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    count = Counter(x for t in train for x in t)
    assert {hash_of(w): n for w, n in count.items()} == {w: n for w, (n, _) in known.items()}
    assert len(history) > 1 and max(history) > history[0]
    table = np.zeros((4, 4))
    for t in train:
        for a, b in zip(["\n", *t], t):  # noqa: B905
            table[known[hash_of(a)][1], known[hash_of(b)][1]] += 1
    assert classlm.likelihood(table) == pytest.approx(max(history))


def test_class_scores_equal_a_plain_recomputation(spark):
    texts, _ = class_texts(spark)
    texts = [t if zlib.crc32(str(i).encode()) % 10 else f"never {t} new{i} b2" for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, known, _ = fitted(docs, classlm.CLASSES, classlm.SWEEPS, classlm.RISE)
    k = classlm.CLASSES
    train = [[*t.split(), "\n"] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    count = Counter(x for t in train for x in t)
    own = {w: known[hash_of(w)][1] for w in count}
    big, types = np.zeros((k + 1, k)), Counter(own.values())
    for t in train:
        for a, b in zip(["\n", *t], t):  # noqa: B905
            big[own[a], own[b]] += 1
            if count[a] == 1:
                big[k, own[b]] += 1
    n, inside = sum(count.values()), big[:k].sum(axis=0)
    single = (inside + 0.1) / (n + 0.1 * k)

    def chance(a, b):
        row = own.get(a, k)
        step = (big[row] + single) / (big[row].sum() + 1)
        if b in own:
            p = step[own[b]] * (count[b] - classlm.DISCOUNT) / inside[own[b]]
        else:
            p = sum(step[j] * classlm.DISCOUNT * types[j] / inside[j] for j in types)
        return classlm.MIX * p + (1 - classlm.MIX) * (count[b] + 0.1) / (n + 0.1 * (len(count) + 1))

    got = {r.doc_id: r.score for r in classlm.class_scores(docs).collect()}
    assert any(t.startswith("never") for t in texts)
    for i, t in enumerate(texts):
        words = [*t.split(), "\n"]
        assert got[i] == pytest.approx(sum(math.log10(chance(a, b)) for a, b in zip(["\n", *words], words)))  # noqa: B905
    # the words and the one not seen add up to one wherever the classes hold all of the transitions
    for a in ("\n", "a1", "never"):
        total = sum(chance(a, b) for b in count) + chance(a, "never")
        empty = sum((big[own.get(a, k)][j] + single[j]) / (big[own.get(a, k)].sum() + 1) for j in range(k) if not types[j])
        assert total == pytest.approx(1 - classlm.MIX * empty)


def test_best_class_equals_moving_the_word():
    rng = np.random.default_rng(5)
    n, k = 40, 5
    pairs = rng.poisson(1, (n, n)).astype(float)
    np.fill_diagonal(pairs, 0)
    own = rng.integers(0, k, n)
    # a word whose neighbours lie in classes that it neither leaves nor enters: its cells are then exact
    w, pairs[0], pairs[:, 0] = 0, 0, 0
    own[0], others = 0, [x for x in range(1, n) if own[x] in (3, 4)]
    pairs[0, others], pairs[others, 0] = 3, 2
    member = np.eye(k)[own]
    table = member.T @ pairs @ member
    after, before = pairs[w] @ member, member.T @ pairs[:, w]
    codes = np.concatenate((np.flatnonzero(after), k + np.flatnonzero(before)))
    counts = np.concatenate((after[after > 0], before[before > 0])).astype(int)
    tries = []
    for j in range(3):
        other = own.copy()
        other[w] = j
        tries.append(likelihood(pairs, other, k))
    wide = classlm.best_classes(own[:1], np.zeros(len(codes), int), codes, counts, table)
    assert wide[0] < 3 and tries[wide[0]] == max(tries)
