"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items are looked for inside long documents, where the Jaccard similarity of item and
document says little. So items are partitioned by their number of shingles, in powers of two, and
each document is cut for each partition into windows of twice that size, half overlapping: an item
contained in the document lies in some window, whose similarity to it has a known lower bound.
Each window and item gets HASHES MinHash values; a window that shares one value with an item of
its partition makes (document, item) a candidate. With 64 values and at least 0.8 of the item in
the window, at most one match in 10**6 is missed by chance. A candidate is verified by the exact
containment of the item's shingles in the whole document.

The items are a query set that all documents meet: they are read in slices of at most SLICE_ITEMS
items and SLICE_BYTES bytes of text, however many there are, and each slice goes to the tasks with
the function. Documents are not shuffled; only matches are.

Words are runs of letters and digits, lower-cased; a shingle is `size` words, or all words of a
shorter text. An item of k words, fewer than `size`, has one shingle, so it is contained where its
words stand in a row: it is looked up among the documents' sequences of k words instead, without
MinHash, for the lengths k that occur. Very long documents are searched whole. Results for odd input: null, empty and wordless documents match nothing, and such
items match nothing; repeated rows of a doc_id share their union of items; a null doc_id is kept,
as one row; an empty benchmark matches nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c

SIZE = 5
CONTAINMENT = 0.8
HASHES = 64
SLICE_ITEMS = 20_000
SLICE_BYTES = 16 << 20

RESULT = "doc_id long, item_id long, containment double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64())])

# Word bytes: ASCII letters and digits and all bytes of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts lying end to end, and the number of each word's text."""
    clean = np.where(WORD[data], c.LOWER[data], np.uint8(32))
    starts, _, text = c.words(clean, offsets)
    return c.word_hashes(clean, starts), text


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts lying end to end, and len+1 offsets into them."""
    units, text = word_units(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n) if n else np.zeros(0, np.int64)
    short = (counts > 0) & (counts < size)
    grams = c.gram_hashes(units, size)
    ok = text[: len(grams)] == text[size - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, owner = grams[ok], text[: len(grams)][ok]
    if short.any():
        at = np.cumsum(counts) - counts
        extra = [c.gram_hashes(units[at[i] : at[i] + counts[i]], int(counts[i]))[0] for i in np.flatnonzero(short)]
        hashes, owner = np.concatenate([hashes, np.array(extra, np.uint64)]), np.concatenate([owner, np.flatnonzero(short)])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def _seeds() -> np.ndarray:
    return c.mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Items:
    """A slice of the items: their shingles, and per size partition their MinHash values."""

    def __init__(self, ids: list[int], texts: list[bytes], size: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        hashes, at = shingles(data, offsets, size)
        self.size = size
        self.ids, self.sets = [], []
        counts = np.bincount(word_units(data, offsets)[1], minlength=len(ids))
        short: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(ids):
            own = np.unique(hashes[at[i] : at[i + 1]])
            if 0 < counts[i] < size:
                short.setdefault(int(counts[i]), []).append((int(own[0]), item))
            elif len(own):
                self.ids.append(item)
                self.sets.append(own)
        # items of k words: their keys in order, and their ids
        self.short = {k: (np.array([x for x, _ in sorted(own)], np.uint64), [i for _, i in sorted(own)]) for k, own in short.items()}
        self.partitions = {}
        seeds = _seeds()
        for number, own in enumerate(self.sets):
            width = 1 << (len(own) - 1).bit_length()
            keys, owners = self.partitions.setdefault(width, ([], []))
            for j, seed in enumerate(seeds):
                keys.append((own * seed).min() ^ np.uint64(j))
                owners.append(number)
        for width, (keys, owners) in self.partitions.items():
            keys, owners = np.array(keys, np.uint64), np.array(owners, np.int64)
            order = np.argsort(keys, kind="stable")
            self.partitions[width] = keys[order], owners[order]

    def candidates(self, hashes: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) whose windows and MinHash values meet."""
        found: set[tuple[int, int]] = set()
        n = np.diff(offsets)
        for width, (keys, owners) in self.partitions.items():
            # starts of blocks of `width` shingles; a window is a block and the next one of its text
            blocks = -(-n // width)
            total = int(blocks.sum())
            if not total:
                continue
            text = np.repeat(np.arange(len(n)), blocks)
            first = np.cumsum(blocks) - blocks
            starts = offsets[:-1][text] + (np.arange(total) - first[text]) * width
            lone = np.append(text[1:] != text[:-1], True)
            for j, seed in enumerate(_seeds()):
                least = np.minimum.reduceat(hashes * seed, starts)
                following = np.append(least[1:], least[-1:])
                least = np.where(lone, least, np.minimum(least, following)) ^ np.uint64(j)
                lo, hi = np.searchsorted(keys, least), np.searchsorted(keys, least, side="right")
                for b in np.flatnonzero(hi > lo):
                    found.update((int(text[b]), int(x)) for x in owners[lo[b] : hi[b]])
        return found

    def short_matches(self, units: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        """(text, item_id) of short items whose words stand in a row in a text."""
        found: set[tuple[int, int]] = set()
        for k, (keys, ids) in self.short.items():
            grams = c.gram_hashes(units, k)
            at = np.flatnonzero((text[: len(grams)] == text[k - 1 :]) & c.is_member(grams, keys)) if len(grams) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(keys, grams[at]), np.searchsorted(keys, grams[at], side="right")
            for t, s, e in set(zip(text[at].tolist(), lo.tolist(), hi.tolist(), strict=True)):
                found.update((t, i) for i in ids[s:e])
        return found

    def matches(self, texts: pa.Array, containment: float) -> Iterator[tuple[int, int, float]]:
        """(text, item_id, containment) of the candidates that an exact count confirms."""
        data, offsets = c.text_bytes(texts)
        for first, _, part, at in c.slices(data, offsets):
            hashes, bounds = shingles(part, at, self.size)
            for text, item in sorted(self.candidates(hashes, bounds)):
                own = self.sets[item]
                share = float(np.isin(own, hashes[bounds[text] : bounds[text + 1]]).mean())
                if share >= containment:
                    yield first + text, self.ids[item], share
            if self.short:
                for text, item_id in sorted(self.short_matches(*word_units(part, at)), key=str):
                    yield first + text, item_id, 1.0


def _matches(items: Items, containment: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": batch.column(0)[text].as_py(), "item_id": item, "containment": share}
                for text, item, share in items.matches(batch.column(1), containment)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    return f


def _item_slices(benchmark: DataFrame) -> Iterator[tuple[list[int], list[bytes]]]:
    """The items in slices of bounded number and bytes, read partition by partition."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text.encode())
        held += len(texts[-1])
        if len(ids) == SLICE_ITEMS or held >= SLICE_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, size: int = SIZE) -> DataFrame:
    """doc_id, item_id, containment: items of which at least that share of shingles is in the document."""
    texts, found = c.texts_of(docs), None
    for ids, items in _item_slices(benchmark):
        part = texts.mapInArrow(_matches(Items(ids, items, size), containment), RESULT)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, size: int = SIZE) -> DataFrame:
    """Per doc_id: contaminated, n_items, items (ids, ascending) and the largest containment (0 if none)."""
    found = contained_items(docs, benchmark, containment, size)
    items = found.groupBy(F.col("doc_id").alias("of")).agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("containment").alias("containment")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(items, F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, size: int = SIZE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for ids, items in _item_slices(benchmark):
        docs = c.filtered(docs, _clean(Items(ids, items, size), containment))
    return docs


def _clean(items: Items, containment: float):
    def keep(texts: pa.Array) -> np.ndarray:
        out = np.ones(len(texts), bool)
        out[[text for text, _, _ in items.matches(texts, containment)]] = False
        return out

    return keep
