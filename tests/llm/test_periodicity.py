"""Periodic runs against plain scans of every period."""

import random
import zlib

import pytest

from tests.llm.brute import sha, words
from tests.llm.conftest import passage
from ticketmill.llm import periodicity
from ticketmill.llm.common import read_table


def plain_runs(w, least=12):
    """All runs by comparing the words a period apart, for every period; the smallest period names a stretch."""
    seen, out = set(), []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(least, 2 * q) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = words(text)
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha(listed.encode()), sha(kept.encode()), len(w))


def test_runs_of_small_words_equal_plain_scans():
    rng = random.Random(5)
    for _ in range(3000):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(45))]
        for least in (2, 12):
            assert periodicity.runs_of(w, least) == plain_runs(w, least), w


def test_runs_of_words_with_long_periods():
    rng = random.Random(6)
    for _ in range(200):
        w = []
        while len(w) < 150:
            part = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
            w += (part * 5)[: rng.randrange(1, 60)]
        assert periodicity.runs_of(w) == plain_runs(w)


def test_fibonacci_words_have_all_their_runs():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert periodicity.runs_of(b, 2) == plain_runs(b, 2)
    assert len(periodicity.runs_of(b, 2)) > 300


def test_one_word_thousands_of_times_is_one_run():
    assert periodicity.runs_of([7] * 20_000) == [(0, 20_000, 1)]


def test_query_equals_plain_scans(spark, odd):
    extra = [(100 + i, " ".join(random.Random(i).choice("ab") for _ in range(60))) for i in range(40)]
    extra += [(200 + i, passage(i, 90)) for i in range(40)] + [(300, passage(1, 40) + " " + passage(1, 40) + " " + passage(1, 17))]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted(map(tuple, periodicity.periodic_runs(docs).collect()), key=repr)
    rows = docs.collect()
    assert got == sorted((plain_row(r.doc_id, r.text) for r in rows), key=repr)
    assert sum(1 for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) > 5


def test_collapsed_text_and_other_columns(spark, odd, nothing):
    docs = spark.createDataFrame([(1, "x " * 20 + "end", "kept", 3)], "doc_id long, text string, mark string, n_words int")
    row = periodicity.find_runs(docs).first()
    assert (row.mark, row.n_words, row.collapsed) == ("kept", 21, "x end")
    assert [tuple(r) for r in row.runs] == [(0, 20, 1)]
    assert periodicity.find_runs(nothing).collect() == []
    assert periodicity.periodic_runs(nothing).collect() == []


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_on_the_smallest_tables(spark, folder):
    docs = read_table(spark, f"/root/testdata/{folder}", "documents")
    short = [r for r in docs.select("doc_id", "text").collect() if len(words(r.text)) < 700]
    got = {r.doc_id: tuple(r) for r in periodicity.periodic_runs(docs).collect()}
    assert len(got) == docs.count()
    for r in short:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)
