"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ticketmill.llm import variants


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def plain_groups(counts, ratio=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{w}".encode())) % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def random_words(seed, n, letters="abc", least=3, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(n)})


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted(x + y for x in ("ab", "cd", "e") for y in ("ing", "ed", "s"))
    acceptor = variants.Acceptor(words)
    assert acceptor.common(acceptor.start, acceptor.start) == words
    alone = variants.Acceptor(["ed", "ing", "s"])
    assert len(acceptor.final) == len(alone.final) + 3  # start, and a state after the first letters of ab and cd


@pytest.mark.parametrize("letters", ["a", "ab", "abcde"])
def test_composition_accepts_each_near_pair_once(letters):
    for seed in range(30):
        words = random_words(seed, 60, letters, 0, 6)
        got = Counter(frozenset(p) for p in variants.Acceptor(words).pairs())
        expected = {frozenset((x, y)) for x in words for y in words if one_edit(x, y)}
        assert set(got) == expected and set(got.values()) <= {1}


@pytest.mark.parametrize(("limit", "longest"), [(20_000, 64), (3, 64), (20_000, 3), (2, 2)])
def test_partitions_find_every_pair_once(spark, limit, longest):
    words = random_words(1, 500, "ab", 0, 11) + random_words(2, 150, "xyzé", 7, 9)
    words += ["q" * n for n in (1, 7, 8, 9, 200, 201, 203)] + ["w" * 150 + x + "v" * 90 for x in ("", "a", "b", "aa")]
    rng = random.Random(3)
    counts = {w: rng.choice([2, 3, 20, 30, 300, 4000]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted(map(tuple, variants.variant_groups(frame, limit=limit, longest=longest).collect()))
    assert got == plain_groups(counts)
    assert any(r[1] not in (None, r[2]) for r in got)


def test_roots_of_long_chains(spark):
    chain = [(f"{'a' * k}{'b' * (12 - k)}", 10**k) for k in range(9)]
    got = {r.word: r for r in variants.variant_groups(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {"a" * 8 + "b" * 4}
    assert got["b" * 12].form == "a" + "b" * 11


def test_query_equals_plain_comparison(spark, odd, nothing):
    rng = random.Random(4)
    base = random_words(5, 40, "abcdefghèÿ", 7, 12)
    texts = [(1000 + i, " ".join(rng.choice(base).title() for _ in range(300)) + " İstanbul×÷x") for i in range(20)]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(texts, "doc_id long, text string"))
    counts = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(map(tuple, variants.spelling_variants(docs).collect()))
    assert got == plain_groups(counts)
    assert sum(1 for r in got if r[1]) > 10
    assert variants.spelling_variants(nothing).collect() == []


def test_a_shared_beginning_of_most_words_is_split(spark):
    words = ["prefixprefix" + w for w in random_words(6, 400, "abcdef", 6, 9)] + random_words(7, 100, "abcdef", 7, 9)
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    start = frame.selectExpr("'' AS key", "word AS window", "CAST(NULL AS INT) AS least", "false AS ends_apart", "word", "n")
    sizes = [r["count"] for r in variants._partitioned(start).groupBy("key").count().collect()]
    assert max(sizes) > 50
    got = {r.word: r.n_near for r in variants.near_words(frame, limit=10).collect()}
    assert got == {w: k for w in words if (k := sum(one_edit(w, x) for x in words))}
