"""Scoring texts with a Brown class-based bigram model, learned from the corpus.

Exchange clustering assigns every word of the training texts, however rare, to one of CLASSES
classes. It starts from a small exact clustering (`exchange`): the FREQUENT most frequent words, the
end of a text and ENDINGS units of the other words by their last bytes. From there, sweeps over the
whole vocabulary run as Spark steps: each word's counts to and from classes are added up by word in
buckets (`evidence`), and each word goes to the class that raises the likelihood of the class
bigrams most (`moved`), all words of a sweep by the same table of class bigrams. Sweeps go on until
one raises the likelihood by less than RISE nats a token; the best assignment counts. The driver gets
tables of classes alone.

A token's probability is that of its class after the class before, times that of the word in its
class; the last is discounted, and what the discount frees in all classes is the probability of a
word not seen. After such a word, classes follow as they do after words seen once. It is mixed with
a unigram share (MIX). All words and the word not seen add up to one if no class is empty.

Texts are tokenised once, into stored chunks of about CHUNK_BYTES: their distinct words, and the
tokens as places among these. A chunk asks the buckets for what belongs to its words, so the
vocabulary is never in one place. Words are compared by 64-bit hashes.

Results for odd input: null and empty texts are one end token; a null doc_id is held out; without
training texts all tokens are unknown and score equals base_score; repeated rows are separate
texts; of classes that raise the likelihood equally the first counts, and a word stays where it is
if none is better; extra columns are ignored. Very long texts are scored whole, a text in one chunk.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c

FREQUENT = 2048
ENDINGS = 1024
CLASSES = 64
SWEEPS = 6
RISE = 0.002
FOLDS = 10
ADDED = 0.1
DISCOUNT = 0.7
MIX = 0.95
CHUNK_BYTES = 16 << 20
TRIPLES = 1 << 15
END = np.uint64(0x5BD1E995A4C93B2F)
NOT_SEEN = 255

CHUNKS = "chunk long, doc_ids array<bigint>, held binary, sizes binary, words binary, endings binary, tokens binary"
COUNTS = "owner int, words binary, endings binary, counts binary"
CLASSED = "owner int, words binary, counts binary, classes binary"
FOUND = "owner int, words binary, widths binary, codes binary, counts binary"
EVIDENCE = "owner int, words binary, classes binary, widths binary, codes binary, counts binary"
REPLIES = "chunk long, owner int, classes binary, counts binary"


def _binary(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(x, pa.binary()) for x in names]


_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *_binary("held", "sizes", "words", "endings", "tokens")])
_COUNTS = pa.schema([("owner", pa.int32()), *_binary("words", "endings", "counts")])
_CLASSED = pa.schema([("owner", pa.int32()), *_binary("words", "counts", "classes")])
_ASKED = pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), *_binary("words")])
_PAIRS = pa.schema([("owner", pa.int32()), *_binary("codes", "counts")])
_FOUND = pa.schema([("owner", pa.int32()), *_binary("words", "widths", "codes", "counts")])
_EVIDENCE = pa.schema([("owner", pa.int32()), *_binary("words", "classes", "widths", "codes", "counts")])
_REPLIES = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), *_binary("classes", "counts")])
_CELLS = pa.schema([("cell", pa.int32()), ("count", pa.int64())])
_TOP = pa.schema([("word", pa.int64()), ("count", pa.int64())])
_LEVELS = pa.schema([("level", pa.int64()), ("words", pa.int64())])
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
)
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
    + [(x, pa.float64()) for x in ("base_score", "score", "perplexity")]
)


def held_out(ids: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([x is None or zlib.crc32(str(x).encode()) % FOLDS == 0 for x in ids.to_pylist()], bool)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, ending, text number) of all tokens; each text's last token is END with ending ENDINGS."""
    data = c.LOWER[data]
    starts, ends, text = c.words(data, offsets)
    hashes = c.word_hashes(data, starts)
    ending = np.zeros(len(starts), np.int64)
    for back in (1, 2, 3):
        at = ends - back
        ending = ending * 257 + np.where(at >= starts, data[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    ending = (c.mixed(ending.astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)
    n = len(offsets) - 1
    place = np.searchsorted(text, np.arange(n), side="right")
    return np.insert(hashes, place, END), np.insert(ending, place, ENDINGS), np.insert(text, place, np.arange(n))


def _distinct(hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice, their endings, and the tokens as places among the words."""
    words, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return words, endings[first], place.astype(np.int32)


def _chunk(number: int, ids: list, parts: list[tuple[np.ndarray, ...]]) -> dict:
    words, endings, first = _distinct(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
    edges = np.cumsum([0, *(len(x[0]) for x in parts)])
    place = np.concatenate([first[s : s + len(x[0])][x[2]] for s, x in zip(edges[:-1], parts, strict=True)])
    sizes = np.concatenate([x[3] for x in parts])
    return {
        "chunk": number,
        "doc_ids": ids,
        "held": held_out(pa.array(ids, pa.int64())).tobytes(),
        "sizes": sizes.astype(np.int32).tobytes(),
        "words": words.tobytes(),
        "endings": endings.astype(np.uint16).tobytes(),
        "tokens": place.tobytes(),
    }


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, parts, size = [], [], 0
    for batch in batches:
        data, offsets = c.text_bytes(batch.column(1))
        doc_ids = batch.column(0).to_pylist()
        for first, end, part, at in c.slices(data, offsets):
            hashes, endings, text = tokens(part, at)
            parts.append((*_distinct(hashes, endings), np.bincount(text, minlength=end - first)))
            ids += doc_ids[first:end]
            size += len(part)
            if size >= CHUNK_BYTES:
                yield c.to_batch([_chunk(number, ids, parts)], _CHUNKS)
                number, ids, parts, size = number + 1, [], [], 0
    if parts:
        yield c.to_batch([_chunk(number, ids, parts)], _CHUNKS)


def chunks_of(docs: DataFrame) -> DataFrame:
    """The tokenised texts, in chunks."""
    return c.texts_of(docs).mapInArrow(_encoded, CHUNKS)


def _training(row: dict) -> np.ndarray:
    """Of each token of a chunk, whether it is in a training text."""
    return np.repeat(~np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int32))


def _word_counts(n_buckets: int):
    """Words of a chunk's training texts with their counts, by bucket."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, endings = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["endings"], np.uint16)
                counts = np.bincount(np.frombuffer(row["tokens"], np.int32)[_training(row)], minlength=len(words))
                own = counts > 0
                words = words[own]
                yield c.to_batch(list(c.packed(("words", "endings", "counts"), c.bucket_of(words, n_buckets), words, endings[own], counts[own])), _COUNTS)

    return f


def _summed(words: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(words, kind="stable")
    at = c.runs(words[order])
    return words[order][at], endings[order][at], np.add.reduceat(counts[order], at) if len(at) else counts


def _entries(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        c.unpacked(table.column("words"), np.uint64),
        c.unpacked(table.column("endings"), np.uint16).astype(np.int64),
        c.unpacked(table.column("counts"), np.int64),
    )


def _bucket(table: pa.Table) -> pa.Table:
    """A bucket's words and their counts in one row."""
    words, endings, counts = _summed(*_entries(table))
    row = {"owner": table.column("owner")[0].as_py(), "words": words.tobytes(), "endings": endings.astype(np.uint16).tobytes(), "counts": counts.tobytes()}
    return pa.Table.from_pylist([row], schema=_COUNTS)


def vocabulary(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """The words of all training texts and their counts, one row a bucket."""
    chunks = chunks.select("held", "sizes", "words", "endings", "tokens")
    return chunks.mapInArrow(_word_counts(n_buckets), COUNTS).groupBy("owner").applyInArrow(_bucket, COUNTS)


def _level(counts: np.ndarray) -> np.ndarray:
    """Quarters of powers of two up to a count."""
    return np.floor(np.log2(counts) * 4).astype(np.int64)


def _count_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the buckets' words have counts of each level."""
    for batch in batches:
        level, words = np.unique(_level(_entries(batch)[2]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(words)], schema=_LEVELS)


def _top_words(least: int):
    """The buckets' words of at least a level of counts; END is a unit of its own."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, counts = _entries(batch)
            keep = (words != END) & (_level(counts) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(words[keep].view(np.int64)), pa.array(counts[keep])], schema=_TOP)

    return f


def frequent_words(vocab: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The hashes of the most frequent words, in order of hash. Counts of counts tell from which on they are."""
    levels = vocab.mapInArrow(_count_levels, "level long, words long").groupBy("level").agg(F.sum("words").alias("words"))
    least, have = 0, 0
    for r in levels.orderBy(F.desc("level")).collect():
        least, have = r.level, have + r.words
        if have > most:  # END may be one of them
            break
    top = vocab.mapInArrow(_top_words(least), "word long, count long").orderBy(F.desc("count"), "word").limit(most)
    return np.sort(np.array([r.word for r in top.collect()], np.int64).view(np.uint64))


def units_of(words: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Units: endings from 0, END at ENDINGS, then the frequent words in the order of their hashes."""
    if not len(frequent):
        return endings
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, ENDINGS + 1 + at, endings)


def _neighbours(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word, next word) of all neighbours in training texts, as places among the chunk's words; a text starts after an END."""
    place = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
    end = np.searchsorted(np.frombuffer(row["words"], np.uint64), END)
    train = _training(row)
    return np.concatenate(([end], place[:-1]))[train], place[train]


def _pairs(frequent: np.ndarray, n_units: int, n_buckets: int):
    """Counts of neighbouring units in training texts, once for a chunk."""
    share = -(-n_units * n_units // n_buckets)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                endings = np.frombuffer(row["endings"], np.uint16).astype(np.int64)
                unit = units_of(np.frombuffer(row["words"], np.uint64), endings, frequent)
                before, after = _neighbours(row)
                code, counts = np.unique(unit[before] * n_units + unit[after], return_counts=True)
                rows = list(c.packed(("codes", "counts"), code // share, code.astype(np.int32), counts.astype(np.int64)))
                yield c.to_batch(rows, _PAIRS)

    return f


def _sum_pairs(table: pa.Table) -> pa.Table:
    codes, counts = c.unpacked(table.column("codes"), np.int32), c.unpacked(table.column("counts"), np.int64)
    order = np.argsort(codes, kind="stable")
    at = c.runs(codes[order])
    row = {"owner": 0, "codes": codes[order][at].tobytes(), "counts": (np.add.reduceat(counts[order], at) if len(at) else counts).tobytes()}
    return pa.Table.from_pylist([row], schema=_PAIRS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit. pairs[a, b]: how often b follows a.

    Each unit in turn goes to the class that gives the class bigrams the highest likelihood, until
    a sweep moves none or all sweeps are done.
    """
    n = len(pairs)
    size = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-size, kind="stable")
    own = np.empty(n, np.int64)
    own[order] = np.arange(n) % classes
    columns = np.ascontiguousarray(pairs.T)
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    table = member.T @ (pairs @ member)
    everyone = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order[size[order] > 0]:
            here, itself = own[w], pairs[w, w]
            after = np.bincount(own, weights=pairs[w], minlength=classes)
            before = np.bincount(own, weights=columns[w], minlength=classes)
            after[here] -= itself
            before[here] -= itself
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= itself
            rows, sums = _xlogx(table), (table.sum(axis=1), table.sum(axis=0))
            gain = (_xlogx(table + after[None, :]) - rows).sum(axis=1)
            gain += (_xlogx(table + before[:, None]) - rows).sum(axis=0)
            diagonal = np.diagonal(table)
            gain += _xlogx(diagonal + after + before + itself) + np.diagonal(rows)
            gain -= _xlogx(diagonal + after) + _xlogx(diagonal + before)
            gain -= _xlogx(sums[0] + after.sum() + itself) - _xlogx(sums[0])
            gain -= _xlogx(sums[1] + before.sum() + itself) - _xlogx(sums[1])
            best = int(gain.argmax())
            if gain[best] <= gain[here] + 1e-9:
                best = here
            moved += best != here
            own[w] = everyone[best]
            table[best] += after
            table[:, best] += before
            table[best, best] += itself
        if not moved:
            break
    return own


def _clusters(n_units: int, classes: int, sweeps: int):
    """The whole (bounded) table of unit pairs becomes the units' classes."""

    def f(table: pa.Table) -> pa.Table:
        codes, counts = c.unpacked(table.column("codes"), np.int32), c.unpacked(table.column("counts"), np.int64)
        pairs = np.zeros(n_units * n_units)
        pairs[codes] = counts
        own = exchange(pairs.reshape(n_units, n_units), classes, sweeps)
        return pa.table({"classes": [own.astype(np.uint8).tobytes()]})

    return f


def _start(frequent: np.ndarray, own: np.ndarray):
    """The buckets' words in the classes of their units."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                endings = np.frombuffer(row["endings"], np.uint16).astype(np.int64)
                unit = units_of(np.frombuffer(row["words"], np.uint64), endings, frequent)
                rows.append({"owner": row["owner"], "words": row["words"], "counts": row["counts"], "classes": own[unit].tobytes()})
            yield c.to_batch(rows, _CLASSED)

    return f


def first_classes(chunks: DataFrame, vocab: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """Every word in the class of its unit, by exact exchange of the units."""
    n = vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")
    frequent = frequent_words(vocab)
    n_units = ENDINGS + 1 + len(frequent)
    pairs = chunks.select("held", "sizes", "words", "endings", "tokens").mapInArrow(_pairs(frequent, n_units, int(n)), "owner int, codes binary, counts binary")
    pairs = pairs.groupBy("owner").applyInArrow(_sum_pairs, "owner int, codes binary, counts binary")
    got = pairs.groupBy("owner").applyInArrow(_clusters(n_units, classes, sweeps), "classes binary").first()
    own = np.frombuffer(got.classes, np.uint8) if got else np.zeros(n_units, np.uint8)
    return vocab.mapInArrow(_start(frequent, own), CLASSED)


def _asked(n_buckets: int):
    """The distinct words of a chunk, by bucket."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                rows = [x | {"chunk": row["chunk"]} for x in c.packed(("words",), c.bucket_of(words, n_buckets), words)]
                yield c.to_batch(rows, _ASKED)

    return f


def _replies(with_counts: bool):
    """To each chunk the class (or NOT_SEEN) and, if wanted, the count (or 0) of each word that it asked for, in its order."""

    def f(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        words = c.unpacked(bucket.column("words"), np.uint64)
        classes, counts = c.unpacked(bucket.column("classes"), np.uint8), c.unpacked(bucket.column("counts"), np.int64)
        rows = []
        for row in asked.to_pylist():
            wanted = np.frombuffer(row["words"], np.uint64)
            known = c.is_member(wanted, words)
            at = np.searchsorted(words, wanted[known])
            found, times = np.full(len(wanted), NOT_SEEN, np.uint8), np.zeros(len(wanted) if with_counts else 0, np.int64)
            found[known] = classes[at]
            if with_counts:
                times[known] = counts[at]
            rows.append({"chunk": row["chunk"], "owner": row["owner"], "classes": found.tobytes(), "counts": times.tobytes()})
        return pa.Table.from_pylist(rows, schema=_REPLIES)

    return f


def replies(chunks: DataFrame, classed: DataFrame, n_buckets: int, with_counts: bool) -> DataFrame:
    asked = chunks.select("chunk", "words").mapInArrow(_asked(n_buckets), "owner int, chunk long, words binary")
    return asked.groupBy("owner").cogroup(classed.groupBy("owner")).applyInArrow(_replies(with_counts), REPLIES)


def _answer(words: np.ndarray, replies: pa.Table, name: str, dtype: type, n_buckets: int) -> np.ndarray:
    """What was replied of each of a chunk's words."""
    out = np.empty(len(words), dtype)
    out[np.argsort(c.bucket_of(words, n_buckets), kind="stable")] = c.unpacked(replies.sort_by("owner").column(name), dtype)
    return out


def _found(n_buckets: int, classes: int):
    """A chunk's words, how often each class follows (codes from 0) and precedes them (codes from `classes`)."""

    def f(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        words = np.frombuffer(row["words"], np.uint64)
        own = _answer(words, replies, "classes", np.uint8, n_buckets).astype(np.int64)
        before, after = _neighbours(row)
        wide = 2 * classes
        codes = np.concatenate((before * wide + own[after], after * wide + classes + own[before]))
        codes, counts = np.unique(codes, return_counts=True)
        word = codes // wide
        at = c.runs(word)
        widths = np.diff(np.append(at, len(word)))
        owner = c.bucket_of(words[word], n_buckets)
        one = c.packed(("words", "widths"), owner[at], words[word[at]], widths.astype(np.uint8))
        more = c.packed(("codes", "counts"), owner, (codes % wide).astype(np.uint8), counts.astype(np.uint32))
        return pa.Table.from_pylist([x | y for x, y in zip(one, more, strict=True)], schema=_FOUND)

    return f


def _gathered(found: pa.Table, classed: pa.Table) -> pa.Table:
    """A bucket's words with their classes and all that was found of them."""
    widths = c.unpacked(found.column("widths"), np.uint8)
    word, place = np.unique(c.unpacked(found.column("words"), np.uint64), return_inverse=True)
    key = np.repeat(place, widths) * 256 + c.unpacked(found.column("codes"), np.uint8)
    order = np.argsort(key, kind="stable")
    at = c.runs(key[order])
    key = key[order][at]
    counts = c.unpacked(found.column("counts"), np.uint32)[order].astype(np.int64)
    counts = np.add.reduceat(counts, at) if len(at) else counts
    widths = np.bincount(key // 256, minlength=len(word))
    own = c.unpacked(classed.column("classes"), np.uint8)[np.searchsorted(c.unpacked(classed.column("words"), np.uint64), word)]
    rows = [
        {
            "owner": found.column("owner")[0].as_py(),
            "words": word.tobytes(),
            "classes": own.tobytes(),
            "widths": widths.astype(np.uint8).tobytes(),
            "codes": (key % 256).astype(np.uint8).tobytes(),
            "counts": counts.tobytes(),
        }
    ] if len(word) else []
    return pa.Table.from_pylist(rows, schema=_EVIDENCE)


def evidence(chunks: DataFrame, classed: DataFrame, n_buckets: int, classes: int) -> DataFrame:
    """Every word's counts to and from classes, one row a bucket."""
    told = replies(chunks, classed, n_buckets, False)
    chunks = chunks.select("chunk", "held", "sizes", "words", "tokens")
    found = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_found(n_buckets, classes), FOUND)
    return found.groupBy("owner").cogroup(classed.groupBy("owner")).applyInArrow(_gathered, EVIDENCE)


def _read(row: dict) -> tuple[np.ndarray, ...]:
    """(classes of words, word place of each entry, codes, counts) of an evidence row."""
    own, widths = np.frombuffer(row["classes"], np.uint8).astype(np.int64), np.frombuffer(row["widths"], np.uint8)
    codes, counts = np.frombuffer(row["codes"], np.uint8).astype(np.int64), np.frombuffer(row["counts"], np.int64)
    return own, np.repeat(np.arange(len(own)), widths), codes, counts


def _times(word: np.ndarray, codes: np.ndarray, counts: np.ndarray, n_words: int, classes: int) -> np.ndarray:
    """How often each word stands in training texts: as often as something precedes it."""
    return np.bincount(word, weights=counts * (codes >= classes), minlength=n_words).astype(np.int64)


def _cells(classes: int):
    """Class bigrams; then the classes that follow words seen once; then the distinct words of each class."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 2) * classes, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, word, codes, counts = _read(row)
                after = codes < classes
                once = after & (_times(word, codes, counts, len(own), classes) == 1)[word]
                for at, cell in ((after, own[word[after]] * classes + codes[after]), (once, classes * classes + codes[once])):
                    total += np.bincount(cell, weights=counts[at], minlength=len(total)).astype(np.int64)
                total += np.bincount((classes + 1) * classes + own, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=_CELLS)

    return f


def class_table(found: DataFrame, classes: int) -> np.ndarray:
    """Rows: classes that follow each class; classes that follow words seen once; distinct words."""
    table = np.zeros((classes + 2) * classes)
    cells = found.select("classes", "widths", "codes", "counts").mapInArrow(_cells(classes), "cell int, count long")
    for r in cells.groupBy("cell").agg(F.sum("count").alias("count")).collect():
        table[r.cell] = r["count"]
    return table.reshape(classes + 2, classes)


def likelihood(bigrams: np.ndarray) -> float:
    """Of the class bigrams, in nats a token; what does not depend on classes left out."""
    parts = _xlogx(bigrams).sum() - _xlogx(bigrams.sum(axis=0)).sum() - _xlogx(bigrams.sum(axis=1)).sum()
    return parts / max(bigrams.sum(), 1)


def best_classes(own: np.ndarray, word: np.ndarray, codes: np.ndarray, counts: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class that each word raises the likelihood most in, the others staying where they are.

    own, word, codes, counts: as `_read` gives them. A cell of the table counts as gaining what the
    word brings, or for the word's own class as losing it.
    """
    classes = len(bigrams)
    # after a word: bigrams[class of the word, next]; before it: bigrams[class before, class of the word]
    sides = np.concatenate((bigrams.T, bigrams))
    sums = np.stack((bigrams.sum(axis=1), bigrams.sum(axis=0)))
    sides_x, sums_x = _xlogx(sides), _xlogx(sums)
    best = own.copy()
    edges = np.searchsorted(word, np.arange(len(own) + 1))
    first = 0
    while first < len(own):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + TRIPLES, side="right")) - 1)
        span = slice(edges[first], edges[last])
        here = own[first:last]
        n, code, who = counts[span], codes[span], word[span] - first
        home = here[who]
        # words share most of their codes and counts, which are small: logarithms once for each
        pair, place = np.unique(n * (2 * classes) + code, return_inverse=True)
        side = pair % (2 * classes)
        gain = (_xlogx(sides[side] + (pair // (2 * classes))[:, None]) - sides_x[side])[place]
        rows = np.arange(len(code))
        gain[rows, home] = sides_x[code, home] - _xlogx(np.maximum(sides[code, home] - n, 0))
        total = np.add.reduceat(gain, edges[first:last] - edges[first], axis=0)
        rows = np.arange(len(here))
        for side, mine in ((0, code < classes), (1, code >= classes)):
            size = np.bincount(who[mine], weights=n[mine], minlength=len(here))
            sizes, place = np.unique(size, return_inverse=True)
            change = (_xlogx(sums[side] + sizes[:, None]) - sums_x[side])[place]
            change[rows, here] = sums_x[side, here] - _xlogx(np.maximum(sums[side, here] - size, 0))
            total -= change
        top = total.argmax(axis=1)
        best[first:last] = np.where(total[rows, top] > total[rows, here] + 1e-9, top, here)
        first = last
    return best


def _moved(bigrams: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, word, codes, counts = _read(row)
                best = best_classes(own, word, codes, counts, bigrams)
                times = _times(word, codes, counts, len(own), len(bigrams))
                yield c.to_batch([{"owner": row["owner"], "words": row["words"], "counts": times.tobytes(), "classes": best.astype(np.uint8).tobytes()}], _CLASSED)

    return f


def moved(found: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """Every word in its best class, by one table of class bigrams."""
    return found.mapInArrow(_moved(bigrams), CLASSED)


@dataclass
class Model:
    """What scoring needs besides the words' classes, of a fixed size. Row `classes` of transitions follows words not seen."""

    train_tokens: int
    types: int
    transitions: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray

    @classmethod
    def of(cls, table: np.ndarray) -> Model:
        bigrams, once, types = table[:-2], table[-2], table[-1]
        tokens = bigrams.sum(axis=0)
        single = (tokens + ADDED) / (tokens.sum() + ADDED * len(tokens))
        follow = table[:-1]
        transitions = (follow + single[None, :]) / (follow.sum(axis=1, keepdims=True) + 1)
        return cls(int(tokens.sum()), int(types.sum()), transitions, tokens, types)


def _written(frame: DataFrame, path: str) -> DataFrame:
    """The rows written at a path, in place of what it held, and read back; packed numbers are mostly small."""
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stored_chunks(docs: DataFrame) -> DataFrame:
    return _written(chunks_of(docs), f"{c.checkpoint_dir(docs.sparkSession)}/chunks-{uuid.uuid4().hex}")


def fit(chunks: DataFrame, n_buckets: int, classes: int = CLASSES, sweeps: int = SWEEPS, rise: float = RISE) -> tuple[Model, DataFrame, list[float]]:
    """The model, the words' counts and classes, and the likelihood of the assignment before each sweep and at the end."""
    if not 0 < classes <= 127:
        raise ValueError("classes must be from 1 to 127")
    spark = chunks.sparkSession
    folder = f"{c.checkpoint_dir(spark)}/classes-{uuid.uuid4().hex}"
    vocab = _written(vocabulary(chunks, n_buckets), f"{folder}/vocabulary")
    classed = _written(first_classes(chunks, vocab, classes), f"{folder}/even")
    best, history = (None, classed), []
    for sweep in range(sweeps + 1):
        found = _written(evidence(chunks, classed, n_buckets, classes), f"{folder}/evidence")
        table = class_table(found, classes)
        c.release(spark)
        history.append(likelihood(table[:-2]))
        before = history[-2] if sweep else -np.inf
        if history[-1] > before:
            best = table, classed
        if history[-1] <= before + rise or sweep == sweeps:
            break
        # the assignment before the last is no longer needed: its folder takes the next one
        classed = _written(moved(found, table[:-2]), f"{folder}/even" if sweep % 2 else f"{folder}/odd")
    return Model.of(best[0]), best[1], history


def _scores(model: Model, n_buckets: int):
    unseen = len(model.class_tokens)
    inside = DISCOUNT * model.class_types / np.maximum(model.class_tokens, 1)
    new = model.transitions @ inside
    whole = model.train_tokens + ADDED * (model.types + 1)

    def f(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        words, sizes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["sizes"], np.int32)
        own = _answer(words, replies, "classes", np.uint8, n_buckets)
        counts = _answer(words, replies, "counts", np.int64, n_buckets)
        own = np.where(counts > 0, own, unseen).astype(np.int64)
        base = (counts + ADDED) / whole
        place = np.frombuffer(row["tokens"], np.int32)
        after = own[place]
        before = np.concatenate((own[[np.searchsorted(words, END)]], after[:-1]))
        if model.train_tokens:
            known = np.minimum(own, unseen - 1)
            share = (counts - DISCOUNT) / np.maximum(model.class_tokens[known], 1)
            chance = np.where(after < unseen, model.transitions[before, known[place]] * share[place], new[before])
            chance = MIX * chance + (1 - MIX) * base[place]
        else:
            chance = base[place]
        text = np.repeat(np.arange(len(sizes)), sizes)
        score = np.bincount(text, weights=np.log10(chance), minlength=len(sizes))
        return pa.table(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(np.frombuffer(row["held"], bool)),
                sizes.astype(np.int64),
                np.bincount(text[counts[place] > 0], minlength=len(sizes)),
                np.full(len(sizes), model.train_tokens),
                np.bincount(text, weights=np.log10(base)[place], minlength=len(sizes)),
                score,
                10 ** (-score / sizes),
            ],
            schema=_RESULT,
        )

    return f


def class_scores(docs: DataFrame, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """Per document: the counts, base_score, score (log10 probability under the class model) and perplexity."""
    n = c.block_count(docs)
    chunks = stored_chunks(docs)
    model, classed, _ = fit(chunks, n, classes, sweeps)
    told = replies(chunks, classed, n, True)
    chunks = chunks.drop("endings")
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scores(model, n), RESULT)
