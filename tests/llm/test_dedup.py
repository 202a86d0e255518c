from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tests.llm import brute
from ticketmill.llm import linededup, simhash, substring, suffix
from ticketmill.llm.components import components


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def by_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_substring_equals_brute_force(odd):
    got = substring.substring_dedup(odd).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans").collect()
    expected = brute.substring(rows_of(odd))
    assert by_order(got) == by_order(expected)
    assert sum(r[2] for r in expected) > 100


@pytest.mark.parametrize("window", [5, 30])
def test_substring_at_other_lengths(odd, window):
    docs = odd.filter("doc_id < 9 OR doc_id IS NULL")
    got = substring.substring_dedup(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans").collect()
    assert by_order(got) == by_order(brute.substring(rows_of(docs), window))


def test_levels_double():
    assert substring.levels(13) == [7, 13]
    assert substring.levels(50) == [7, 13, 25, 50]
    assert substring.levels(5) == [5]


@pytest.mark.parametrize(("frequent", "piece"), [(suffix.FREQUENT, suffix.PIECE), (1, suffix.PIECE), (2, suffix.PIECE), (suffix.FREQUENT, 37), (2, 211)])
def test_suffix_equals_brute_force(odd, frequent, piece, monkeypatch):
    monkeypatch.setattr(suffix, "FREQUENT", frequent)
    monkeypatch.setattr(suffix, "PIECE", piece)
    got = suffix.suffix_dedup(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    expected = brute.suffix(rows_of(odd))
    assert by_order(got) == by_order(expected)
    assert sum(r[2] for r in expected) > 500


def test_pieces_hold_each_window_once():
    data = np.arange(1000, dtype=np.uint16)
    got = list(suffix.pieces(data, np.array([0, 0, 700, 710, 1000]), 20, 64))
    assert [(first, end) for first, end, _ in got] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    starts = [begin + i for begin, part, _ in got[1][2] for i in range(len(part) - 19)]
    assert starts == list(range(681))
    assert all(part.tolist() == data[begin : begin + len(part)].tolist() for begin, part, _ in got[1][2])


def test_spans_do_not_cross_texts():
    starts, ends = suffix.spans(np.array([5, 0, 8, 30, 20]), np.array([9, 3, 20, 40, 25]), np.array([0, 20, 20, 50]))
    assert (starts.tolist(), ends.tolist()) == ([0, 5, 20, 30], [3, 20, 25, 40])


@pytest.mark.parametrize("frequent", [suffix.FREQUENT, 2])
def test_maximal_repeats_are_equal_and_cover_what_goes(odd, frequent, monkeypatch):
    monkeypatch.setattr(suffix, "FREQUENT", frequent)
    docs = odd.filter("doc_id <> 9 AND doc_id IS NOT NULL")
    text = {i: (t or "").encode() for i, t in rows_of(docs)}
    found = suffix.maximal_repeats(docs).toPandas()
    covered = {i: [False] * len(t) for i, t in text.items()}
    for _, group in found.groupby("repeat_id"):
        strings = {text[r.doc_id][r.start : r.start + r.length] for r in group.itertuples()}
        assert len(strings) == 1 and len(group) > 1 and group.length.min() >= 200
        for r in group.itertuples():
            covered[r.doc_id][r.start : r.start + r.length] = [True] * r.length
    expected = {r[0]: r[2] for r in brute.suffix(list((i, t.decode()) for i, t in text.items()))}
    assert {i: sum(x) for i, x in covered.items()} == expected


def test_intervals_of_a_common_prefix_array():
    assert sorted(suffix.intervals([2, 0, 3, 3, 1])) == [(0, 0, 5), (1, 2, 5), (2, 0, 1), (3, 2, 4)]


@pytest.mark.parametrize("tile", [2048, 2])
def test_lines_equal_brute_force(odd, tile, monkeypatch):
    monkeypatch.setattr(linededup, "TILE", tile)
    monkeypatch.setattr(linededup, "FREQUENT", 3 if tile == 2 else linededup.FREQUENT)
    docs = odd.filter("doc_id <> 9 OR doc_id IS NULL") if tile == 2 else odd.dropDuplicates(["doc_id", "text"])
    expected = brute.lines(rows_of(docs))
    got = linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "n_links").collect()
    assert by_order(got) == by_order(expected)
    assert sum(r[3] for r in expected) >= 6


def test_lines_pass_other_columns(odd):
    got = linededup.dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "bits", "size", "mark", "words", "n_lines", "n_removed", "n_links", "first_doc"]


@pytest.mark.parametrize("pairs", [linededup.PAIRS, 2000, 50])
def test_many_near_copies_are_verified_in_parts(spark, pairs, monkeypatch):
    """A group of lines that are all alike but for one word: every two of them are a link."""
    monkeypatch.setattr(linededup, "PAIRS", pairs)
    monkeypatch.setattr(linededup, "FLUSH", pairs)
    monkeypatch.setattr(linededup, "TILE", 64)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*base, f"x{i}", f"y{i % 7}"])) for i in range(300)] + [(400 + i, f"line number {i} of others z{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = linededup.line_dedup(docs).select("doc_id", "class_id", "n_links", "n_removed").collect()
    expected = [(i, 0, 299, int(i > 0)) for i in range(300)] + [(400 + i, 400 + i, 0, 0) for i in range(50)]
    assert sorted(map(tuple, got)) == expected


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = env.blockManager().diskBlockManager().localDirs()
    return {x: x.stat().st_size for folder in folders for x in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_steps_of_lines_leave_no_shuffle_files(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 400)) + "\none line of six common words" for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(cleanup)
    kept = linededup.dedup_lines(docs)
    left = sum(size for x, size in shuffle_files(spark).items() if x not in before)
    assert left < sum(map(len, texts)) / 20
    assert spark.conf.get(cleanup) == setting
    assert kept.filter("n_removed = 1").count() == 99


def test_simhash_equals_brute_force(odd):
    got = simhash.simhash_dedup(odd).collect()
    assert by_order(got) == by_order(brute.simhash(rows_of(odd)))


@pytest.mark.parametrize("tile", [simhash.TILE, 300])
def test_tiles_lose_no_component(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 5, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 2), dtype=np.uint64), axis=1) for s in seeds]
    bits = np.unique(np.concatenate([*near, rng.integers(0, 2**63, 400, dtype=np.uint64)]))
    marks = spark.createDataFrame(pd.DataFrame({"bits": bits.view(np.int64), "node": np.arange(len(bits))}))
    got = {r.node: r.component for r in components(simhash.near_links(marks)).collect()}
    label, near = np.arange(len(bits)), np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    while (label != (label := np.where(near, label[None, :], len(bits)).min(axis=1))).any():
        pass
    linked = near.sum(axis=1) > 1
    assert got == {int(i): int(label[i]) for i in np.flatnonzero(linked)}


def test_addresses_meet_whatever_bits_differ():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.addresses(n, 3)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not flips & m for m in masks)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 7), (200, 201), (201, 202)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in [*range(61), 100]} | {200: 200, 201: 200, 202: 200}


def test_keep_one_of_each_component(odd):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    marks = brute.simhash(rows_of(odd))
    wanted = {c for _, _, c in marks if c is not None}
    assert sorted(i for i, _ in kept if i is not None) == sorted(wanted)


@pytest.mark.parametrize("run", [substring.substring_dedup, suffix.suffix_dedup, linededup.line_dedup, simhash.simhash_dedup, simhash.keep_one])
def test_empty_tables(nothing, run):
    assert run(nothing).collect() == []
