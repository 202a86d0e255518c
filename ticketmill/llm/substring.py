"""Substring dedup by level-wise doubling.

A window of `window` words can repeat only if every shorter run of words in it repeats. So the
work goes by levels, each about twice as long as the one before (7 and 13 words for a window of
13; 7, 13, 25 and 50 for one of 50). At a level a window is represented by the least hash of the
runs of the lower level inside it, which two equal windows share. Runs that no other document
holds end there; only windows whose representative repeats go on to the next level, until the
full length is reached or no candidates survive. At the full length the smallest doc_id of each
window decides.

Results for odd input: null, empty and blank texts have no words (the hash is that of the empty
string); texts shorter than the window lose nothing; very long
texts are processed whole; repeated rows of one doc_id count as one
document and remove nothing from each other; a null doc_id counts as larger than any other;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketmill.llm import common as c

WINDOW = 13
SHORTEST = 8

ENTRIES = "owner int, block int, keys binary, many binary"
FINAL_ENTRIES = "owner int, block int, keys binary, ids binary"
REPLIES = "block int, keys binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"

_ENTRIES = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
_FINAL = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
_REPLIES = pa.schema([("block", pa.int32()), ("keys", pa.binary())])
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64())]
)


def levels(window: int) -> list[int]:
    """Lengths up to the window, each at most twice the one before."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Windows:
    """Hashes of the runs of words of some texts at each level."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lengths: list[int]):
        self.starts, self.ends, self.text = c.words(data, offsets)
        self.lengths = lengths
        self.units = c.word_hashes(data, self.starts)

    def names(self, level: int) -> np.ndarray:
        return c.gram_hashes(self.units, self.lengths[level])

    def valid(self, level: int) -> np.ndarray:
        """Whether the run from each position on lies in one text."""
        k = self.lengths[level]
        return self.text[: len(self.text) - k + 1] == self.text[k - 1 :] if len(self.text) >= k else np.zeros(0, bool)

    def representatives(self, level: int) -> np.ndarray:
        """For each window of the next level, the least name of this level inside it."""
        return c.sliding_min(self.names(level), self.lengths[level + 1] - self.lengths[level] + 1)

    def alive(self, level: int, survivors: np.ndarray) -> np.ndarray:
        """Windows of `level` whose representative one level below repeats."""
        ok = self.valid(level)
        return ok & c.is_member(self.representatives(level - 1), survivors) if level else ok


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest id of each, and whether a second id holds it."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    at = c.runs(keys)
    if not len(at):
        return keys, ids, np.zeros(0, bool)
    low, high = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    return keys[at], low, low != high


def _level_entries(lengths: list[int], level: int, n_buckets: int):
    """Representatives of the windows one level up, once for the block."""

    def f(docs: pa.Table, survivors: np.ndarray, block: int) -> pa.Table:
        data, offsets = c.text_bytes(docs.column("text"))
        ids = c.id_values(docs.column("doc_id"))
        keys, owners = [], []
        for first, _, part, at in c.slices(data, offsets):
            w = Windows(part, at, lengths)
            ok = w.valid(level + 1)
            rep = w.representatives(level)
            if level:
                inner = w.alive(level, survivors)
                ok &= c.sliding_min(inner.astype(np.uint8), lengths[level + 1] - lengths[level] + 1).astype(bool)
            text = w.text[: len(rep)]
            if len(rep) > 1:
                ok[1:] &= (rep[1:] != rep[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
            keys.append(rep[ok])
            owners.append(ids[first + text[ok]])
        keys, low, many = _distinct(np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)]))
        rows = [x | {"block": block} for x in c.packed(("keys", "many"), c.bucket_of(keys, n_buckets), keys, many)]
        return pa.Table.from_pylist(rows, schema=_ENTRIES)

    return f


def _final_entries(lengths: list[int], n_buckets: int):
    """Windows of the full length that may repeat, once for the block, with the block's smallest doc_id."""

    def f(docs: pa.Table, survivors: np.ndarray, block: int) -> pa.Table:
        data, offsets = c.text_bytes(docs.column("text"))
        ids = c.id_values(docs.column("doc_id"))
        keys, owners = [], []
        for first, _, part, at in c.slices(data, offsets):
            w = Windows(part, at, lengths)
            ok = w.alive(len(lengths) - 1, survivors)
            keys.append(w.names(len(lengths) - 1)[ok])
            owners.append(ids[first + w.text[: len(ok)][ok]])
        keys, low, _ = _distinct(np.concatenate(keys or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)]))
        rows = [x | {"block": block} for x in c.packed(("keys", "ids"), c.bucket_of(keys, n_buckets), keys, low)]
        return pa.Table.from_pylist(rows, schema=_FINAL)

    return f


def _gathered(entries: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a bucket in order, with their blocks and the column `name`."""
    keys = c.unpacked(entries.column("keys"), np.uint64)
    sizes = [len(x) // 8 for x in entries.column("keys").to_pylist()]
    blocks = np.repeat(entries.column("block").to_numpy(), sizes)
    order = np.argsort(keys, kind="stable")
    return keys[order], blocks[order], c.unpacked(entries.column(name), dtype)[order]


def _reply(blocks: np.ndarray, keys: np.ndarray) -> pa.Table:
    rows = [{"block": x["owner"], "keys": x["keys"]} for x in c.packed(("keys",), blocks, keys)]
    return pa.Table.from_pylist(rows, schema=_REPLIES)


def _repeated(entries: pa.Table) -> pa.Table:
    """To each block its keys that more than one document holds."""
    keys, blocks, many = _gathered(entries, "many", np.uint8)
    at = c.runs(keys)
    sizes = np.diff(np.append(at, len(keys)))
    again = (sizes > 1) | (np.maximum.reduceat(many, at) > 0 if len(at) else np.zeros(0, bool))
    keep = np.repeat(again, sizes)
    return _reply(blocks[keep], keys[keep])


def _earlier(entries: pa.Table) -> pa.Table:
    """To each block its windows that a smaller doc_id of another block holds."""
    keys, blocks, ids = _gathered(entries, "ids", np.int64)
    at = c.runs(keys)
    low = np.repeat(np.minimum.reduceat(ids, at) if len(at) else ids, np.diff(np.append(at, len(keys))))
    return _reply(blocks[ids > low], keys[ids > low])


def covered_words(docs: pa.Table, replies: pa.Table, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the block go (in text order), and the text number of each word."""
    data, offsets = c.text_bytes(docs.column("text"))
    ids = c.id_values(docs.column("doc_id"))
    last = len(lengths) - 1
    names, texts, oks = [], [], []
    for first, _, part, at in c.slices(data, offsets):
        w = Windows(part, at, lengths)
        ok = w.valid(last)
        full, some = np.zeros(len(w.text), bool), np.zeros(len(w.text), np.uint64)
        full[: len(ok)] = ok
        some[: len(ok)] = w.names(last)
        names.append(some)
        oks.append(full)
        texts.append(w.text + first)
    if not names:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    names, oks, texts = np.concatenate(names), np.concatenate(oks), np.concatenate(texts)
    at = np.flatnonzero(oks)
    later = c.is_member(names[at], np.sort(c.unpacked(replies.column("keys"), np.uint64)))
    order = np.argsort(names[at], kind="stable")
    starts = c.runs(names[at][order])
    if len(starts):
        owners = ids[texts[at[order]]]
        low = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(order))))
        later[order] |= owners > low
    marks = np.zeros(len(names) + lengths[-1] + 1, np.int32)
    np.add.at(marks, at[later], 1)
    np.add.at(marks, at[later] + lengths[-1], -1)
    return np.cumsum(marks)[: len(names)] > 0, texts


def _results(lengths: list[int]):
    def f(docs: pa.Table, replies: pa.Table) -> pa.Table:
        gone, texts = covered_words(docs, replies, lengths)
        n = docs.num_rows
        at = np.searchsorted(texts, np.arange(n + 1))
        rows = {"doc_id": docs.column("doc_id"), "n_words": np.diff(at), "n_removed": [], "kept_sha256": [], "n_spans": []}
        for i, text in enumerate(docs.column("text")):
            mask = gone[at[i] : at[i + 1]]
            units = (text.as_py() or "").encode().split()
            if mask.any():
                units = compress(units, ~mask)
            rows["n_removed"].append(int(mask.sum()))
            rows["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            rows["kept_sha256"].append(hashlib.sha256(b" ".join(units)).hexdigest())
        return pa.table(rows, schema=_RESULT)

    return f


def _alone(f):
    none = np.zeros(0, np.uint64)
    return lambda docs: f(docs, none, docs.column("block")[0].as_py())


def _with_survivors(f):
    def g(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return f(docs, np.zeros(0, np.uint64), 0)
        survivors = np.sort(c.unpacked(replies.column("keys"), np.uint64))
        return f(docs, survivors, docs.column("block")[0].as_py())

    return g


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_removed, n_spans (maximal removed runs) and the hash of the kept words.

    A word goes if a window over it has a word sequence that also starts in a smaller doc_id.
    """
    lengths, n = levels(window), c.block_count(docs)
    base = c.in_blocks(docs, n)
    replies = None
    for level in range(len(lengths) - 1):
        f = _level_entries(lengths, level, n)
        entries = c.by_block(base, _alone(f), ENTRIES) if replies is None else c.by_block_with(base, replies, _with_survivors(f), ENTRIES)
        replies = entries.groupBy("owner").applyInArrow(_repeated, REPLIES)
    f = _final_entries(lengths, n)
    entries = c.by_block(base, _alone(f), FINAL_ENTRIES) if replies is None else c.by_block_with(base, replies, _with_survivors(f), FINAL_ENTRIES)
    replies = entries.groupBy("owner").applyInArrow(_earlier, REPLIES)
    return c.by_block_with(base, replies, _results(lengths), RESULT)
