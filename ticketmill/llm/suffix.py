"""Suffix-array dedup: maximal repeats of at least `length` bytes, over all documents.

Which suffixes are sorted. Every window of `length` bytes has an anchor: the place of its least
GRAM-byte hash (the leftmost of equal ones). Equal windows have equal anchors at equal distances,
so only suffixes that start at anchors need sorting, about one byte in 90 for 200 bytes. An anchor
whose gram occurs once ends there. For the others a context is taken: all windows that have this
anchor, so up to 176 bytes before it and 200 from it on. Contexts of one gram meet in one bucket;
equal contexts of a block travel as one with a mark, so a passage that a third of all documents
hold travels once a block.

In a bucket, the suffixes from the anchors are sorted into an enhanced suffix array: order and
common prefixes of neighbours. A stack scan lists its common-prefix intervals. Within an interval
of prefix length r, the texts before the anchors are sorted from the anchor leftwards; a second
scan with at least length - r common bytes gives sets whose bytes before differ (left-extension
diversity, or the context's edge) while the interval's end makes the bytes after differ: a maximal
repeat with all its occurrences, not only neighbours. Longer repeats hold several anchors and come
out as overlapping pieces, one for each; the removed bytes are their union.

Grams that occur more than FREQUENT times do not gather: their windows are compared one by one, as
suffixes cut at `length` bytes, and equal ones of a block travel as one. A window so frequent that
a third of all documents hold it reaches its bucket once a block.

A text of over PIECE bytes is read in pieces that share `length` - 1 bytes, so each window lies in one
piece and arrays stay small however long a text is. The windows of an anchor at a border come as two
contexts; these share `length` - 1 bytes, which is no repeat.

Results for odd input: null and empty texts have 0 bytes and the hash of the empty string; texts
under `length` bytes lose nothing; very long texts are processed whole, up to the 2 GB of a value in
Spark; equal texts lose all that they share, as no place has precedence; repeated rows of one doc_id are separate texts, so both lose
what they share; a null doc_id is carried through; extra columns are ignored. Removal works on
bytes and may split a character of several bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ticketmill.llm import common as c

LENGTH = 200
GRAM = 24
FREQUENT = 50_000
PIECE = c.SLICE_BYTES
PLACE = (1 << 28) - 1  # bytes of a piece that a place can address

ENTRIES = "owner int, block int, keys binary, times binary"
SURVIVORS = "block int, keys binary, frequent binary"
CONTEXTS = "owner int, block int, keys binary, contexts binary, lefts binary, rights binary, many binary, bytes binary, windows binary, grams binary"
REPLIES = "block int, contexts binary, lefts binary, rights binary, repeats binary, windows binary, grams binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
OCCURRENCES = "repeat_id long, length long, doc_id long, start long"

_ENTRIES = pa.schema([("owner", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
_SURVIVORS = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("frequent", pa.binary())])
_CONTEXTS = pa.schema(
    [("owner", pa.int32()), ("block", pa.int32())]
    + [(x, pa.binary()) for x in ("keys", "contexts", "lefts", "rights", "many", "bytes", "windows", "grams")]
)
_REPLIES = pa.schema([("block", pa.int32())] + [(x, pa.binary()) for x in ("contexts", "lefts", "rights", "repeats", "windows", "grams")])
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)
_OCCURRENCES = pa.schema([("repeat_id", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """(first row, end row, parts) of runs of whole texts; a part is (its first byte in the run, bytes, offsets).

    Each window of `length` bytes lies in one part: a text with over `piece` windows is one run of several parts.
    """
    for first, end, run, at in c.slices(data, offsets, min(c.SLICE_BYTES, piece)):
        windows = len(run) - length + 1
        if end - first > 1 or windows <= piece:
            yield first, end, [(0, run, at)]
            continue
        cut = [(b, run[b : min(b + piece, windows) + length - 1]) for b in range(0, windows, piece)]
        yield first, end, [(b, part, np.array([0, len(part)])) for b, part in cut]


class Anchors:
    """The anchors of the windows of some texts lying end to end, with each one's run of windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n = len(data)
        if n > PLACE:
            raise ValueError(f"a piece of {n} bytes is over the {PLACE} bytes that places can address")
        none = np.zeros(0, np.int64)
        self.place = self.first = self.last = none
        self.keys = np.zeros(0, np.uint64)
        self.sums = None
        if n < length:
            return
        terms = c.BYTE_VALUES[data]
        terms *= c.powers(c.BASE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        grams = self._hash(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
        ranked = (grams & np.uint64(~PLACE & ((1 << 64) - 1))) | np.arange(len(grams), dtype=np.uint64)
        place = (c.sliding_min(ranked, length - GRAM + 1) & np.uint64(PLACE)).astype(np.int64)
        sizes = np.diff(offsets)
        marks = np.zeros(n + 1, np.int32)
        long = sizes >= length
        np.add.at(marks, offsets[:-1][long], 1)
        np.add.at(marks, offsets[1:][long] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(marks)[: len(place)] > 0)
        starts = c.runs(place[at])
        if not len(starts):
            return
        self.first, self.last = at[starts], at[np.append(starts[1:], len(at)) - 1]
        self.place = place[self.first]
        self.keys = grams[self.place]

    def _hash(self, lo, hi) -> np.ndarray:
        return c.mixed((self.sums[hi] - self.sums[lo]) * c.powers(c.BASE_INVERSE, len(self.sums))[lo])

    def contexts(self, length: int) -> np.ndarray:
        """A hash of each context: its bytes and where the anchor lies in them."""
        if self.sums is None or not len(self.place):
            return np.zeros(0, np.uint64)
        shape = ((self.place - self.first) << 32 | (self.last + length - self.place)).astype(np.uint64)
        return c.mixed(self._hash(self.first, self.last + length) ^ c.mixed(shape + np.uint64(1)))


    def windows(self, of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hashes, grams) of all windows of the chosen anchors."""
        if not of.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        times = (self.last - self.first + 1)[of]
        starts = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[of], times)
        return starts, c.mixed(self._hash(starts, starts + length) + np.uint64(1)), np.repeat(self.keys[of], times)


def _anchor_entries(length: int, n_buckets: int, piece: int):
    def f(docs: pa.Table) -> pa.Table:
        data, offsets = c.text_bytes(docs.column("text"))
        block = docs.column("block")[0].as_py()
        cut = pieces(data, offsets, length, piece)
        keys = np.sort(np.concatenate([Anchors(part, at, length).keys for _, _, parts in cut for _, part, at in parts]))
        at = c.runs(keys)
        times = np.minimum(np.diff(np.append(at, len(keys))), (1 << 16) - 1).astype(np.uint16)
        rows = [x | {"block": block} for x in c.packed(("keys", "times"), c.bucket_of(keys[at], n_buckets), keys[at], times)]
        return pa.Table.from_pylist(rows, schema=_ENTRIES)

    return f


def _repeated(frequent: int):
    """To each block its grams that occur more than once, and which of them occur more than `frequent` times."""

    def f(entries: pa.Table) -> pa.Table:
        keys = c.unpacked(entries.column("keys"), np.uint64)
        blocks = np.repeat(entries.column("block").to_numpy(), [len(x) // 8 for x in entries.column("keys").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, blocks, times = keys[order], blocks[order], c.unpacked(entries.column("times"), np.uint16)[order].astype(np.int64)
        at = c.runs(keys)
        total = np.repeat(np.add.reduceat(times, at) if len(at) else times, np.diff(np.append(at, len(keys))))
        keep = total > 1
        names = ("keys", "frequent")
        rows = [{"block": x.pop("owner")} | x for x in c.packed(names, blocks[keep], keys[keep], total[keep] > frequent)]
        return pa.Table.from_pylist(rows, schema=_SURVIVORS)

    return f


def _context_entries(length: int, n_buckets: int, piece: int):
    """The contexts of anchors whose gram repeats, equal ones of the block once."""

    def f(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return pa.Table.from_pylist([], schema=_CONTEXTS)
        data, offsets = c.text_bytes(docs.column("text"))
        block = docs.column("block")[0].as_py()
        survivors = c.unpacked(replies.column("keys"), np.uint64)
        often = c.unpacked(replies.column("frequent"), np.uint8) > 0
        frequent, survivors = np.sort(survivors[often]), np.sort(survivors[~often])
        found, windows = [], []
        for first, _, parts in pieces(data, offsets, length, piece):
            for begin, part, at in parts:
                a = Anchors(part, at, length)
                if len(frequent):
                    windows.append(a.windows(c.is_member(a.keys, frequent), length)[1:])
                keep = c.is_member(a.keys, survivors)
                lefts, rights = a.place - a.first, a.last + length - a.place
                found.append((a.keys[keep], a.contexts(length)[keep], lefts[keep], rights[keep], a.first[keep] + offsets[first] + begin))
        keys, contexts, lefts, rights, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(contexts, kind="stable")
        at = c.runs(contexts[order])
        many = np.diff(np.append(at, len(order))) > 1
        one = order[at]
        keys, contexts, lefts, rights, starts = (x[one] for x in (keys, contexts, lefts, rights, starts))
        owner = c.bucket_of(keys, n_buckets)
        order = np.lexsort((keys, owner))
        owners, raw, rows = owner[order], data.tobytes(), []
        for s, e in c.run_bounds(owners):
            of = order[s:e]
            rows.append(
                {
                    "owner": int(owners[s]),
                    "block": block,
                    "keys": keys[of].tobytes(),
                    "contexts": contexts[of].tobytes(),
                    "lefts": lefts[of].astype(np.uint16).tobytes(),
                    "rights": rights[of].astype(np.uint16).tobytes(),
                    "many": many[of].tobytes(),
                    "bytes": b"".join(raw[b : b + n] for b, n in zip(starts[of].tolist(), (lefts[of] + rights[of]).tolist(), strict=True)),
                }
            )
        if windows:
            names, grams = (np.concatenate(x) for x in zip(*windows, strict=True))
            order = np.argsort(names, kind="stable")
            names, grams = names[order], grams[order]
            at = c.runs(names)
            again = np.diff(np.append(at, len(names))) > 1
            packed = c.packed(("windows", "grams", "many"), c.bucket_of(names[at], n_buckets), names[at], grams[at], again)
            rows += [x | {"block": block} for x in packed]
        return pa.Table.from_pylist(rows, schema=_CONTEXTS)

    return f


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """One row of `width` bytes for each text: its bytes from `starts` on in direction `step`, then zeros."""
    columns = np.arange(width)
    at = starts[:, None] + step * columns[None, :]
    inside = columns[None, :] < sizes[:, None]
    at[~inside] = 0
    out = data[at]
    out[~inside] = 0
    return out


def _order(groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows in order of group and then of their bytes."""
    pad = -rows.shape[1] % 8
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    return np.lexsort([*wide.T[::-1], groups])


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows of a and b, at most `most`."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (common prefix, first row, last row) of every common-prefix interval.

    common[i] is what rows i and i+1 of a sorted array share.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > value:
            had, first = stack.pop()
            yield had, first, i
        if not stack or stack[-1][0] < value:
            stack.append((value, first))


def _repeats_of_group(rows: np.ndarray, common: np.ndarray, rank: np.ndarray, left: np.ndarray, lefts: np.ndarray, length: int):
    """(bytes before the anchor, from it on, rows) of the maximal repeats of one group of contexts.

    rows: the group's contexts in suffix order; common: what neighbours share; rank: their order
    leftwards from the anchor; left: their bytes leftwards.
    """
    for right, lo, hi in intervals(common.tolist()):
        need = max(0, length - right)
        members = rows[lo : hi + 1]
        members = members[lefts[members] >= need]
        if len(members) < 2:
            continue
        members = members[np.argsort(rank[members], kind="stable")]
        a, b = members[:-1], members[1:]
        shared = _common(left[a], left[b], np.minimum(lefts[a], lefts[b]))
        if shared.max() < need:
            continue
        for before, first, last in intervals(np.where(shared >= need, shared, -1).tolist()):
            if before >= need:
                yield before, right, members[first : last + 1]


def bucket_repeats(entries: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """(row of `entries`' contexts, bytes before, bytes from the anchor on, repeat) for every occurrence."""
    keys, contexts = (c.unpacked(entries.column(x), np.uint64) for x in ("keys", "contexts"))
    lefts, rights = (c.unpacked(entries.column(x), np.uint16).astype(np.int64) for x in ("lefts", "rights"))
    many = c.unpacked(entries.column("many"), np.uint8) > 0
    data = c.unpacked(entries.column("bytes"), np.uint8)
    starts = np.cumsum(lefts + rights) - lefts - rights
    order = np.lexsort((contexts, keys))
    edge = np.ones(len(order), bool)
    edge[1:] = (keys[order][1:] != keys[order][:-1]) | (contexts[order][1:] != contexts[order][:-1])
    at = np.flatnonzero(edge)
    one = order[at]
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.cumsum(edge) - 1
    whole = (np.diff(np.append(at, len(order))) > 1) | (np.maximum.reduceat(many[order], at) if len(at) else np.zeros(0, bool))
    group = np.cumsum(np.concatenate(([0], keys[one][1:] != keys[one][:-1]))) if len(one) else np.zeros(0, np.int64)
    sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)

    found_class, found_left, found_right, found_id = [np.flatnonzero(whole)], [lefts[one][whole]], [rights[one][whole]], [contexts[one][whole]]
    several = np.flatnonzero(sizes[group] > 1) if len(group) else group
    if len(several):
        own, l, r = one[several], lefts[one][several], rights[one][several]
        g = group[several]
        anchor = starts[own] + l
        right = _matrix(data, anchor, r, length, 1)
        left = _matrix(data, anchor - 1, l, length - GRAM, -1)
        by_right = _order(g, right)
        rank = np.empty(len(g), np.int64)
        rank[_order(g, left)] = np.arange(len(g))
        a, b = by_right[:-1], by_right[1:]
        common = _common(right[a], right[b], np.minimum(r[a], r[b]))
        edges = c.runs(g[by_right])
        ends = np.append(edges[1:], len(g))
        pair = ends - edges == 2
        x, y = by_right[edges[pair]], by_right[edges[pair] + 1]
        shared_right = common[edges[pair]]
        shared_left = _common(left[x], left[y], np.minimum(l[x], l[y]))
        ok = shared_right + shared_left >= length
        name = c.mixed(contexts[own[x]] ^ c.mixed(contexts[own[y]]))[ok]
        for side in (x[ok], y[ok]):
            found_class.append(several[side])
            found_left.append(shared_left[ok])
            found_right.append(shared_right[ok])
            found_id.append(name)
        for s, e in zip(edges[~pair], ends[~pair], strict=True):
            for before, after, members in _repeats_of_group(by_right[s:e], common[s : e - 1], rank, left, l, length):
                found_class.append(several[members])
                found_left.append(np.full(len(members), before))
                found_right.append(np.full(len(members), after))
                low = contexts[own[members]].min()
                found_id.append(c.mixed(np.full(len(members), low + np.uint64(before << 32 | after), np.uint64)))
    classes, befores, afters, ids = (np.concatenate(v) for v in (found_class, found_left, found_right, found_id))
    return class_of, classes, befores, afters, ids


def _window_replies(entries: pa.Table) -> list[dict]:
    """To each block its windows that occur more than once, of a bucket's frequent grams."""
    names, grams = (c.unpacked(entries.column(x), np.uint64) for x in ("windows", "grams"))
    many = c.unpacked(entries.column("many"), np.uint8) > 0
    blocks = np.repeat(entries.column("block").to_numpy(), [len(x) // 8 for x in entries.column("windows").to_pylist()])
    order = np.argsort(names, kind="stable")
    at = c.runs(names[order])
    if not len(at):
        return []
    times = np.diff(np.append(at, len(order)))
    keep = order[np.repeat((times > 1) | np.maximum.reduceat(many[order], at), times)]
    return [{"block": x.pop("owner")} | x for x in c.packed(("windows", "grams"), blocks[keep], names[keep], grams[keep])]


def _reply(length: int, widest: bool):
    """Occurrences back to the blocks; `widest`: only the furthest bytes on either side for each context."""

    def f(table: pa.Table) -> pa.Table:
        alone = pc.is_valid(table.column("windows"))
        entries = table.filter(pc.invert(alone))
        class_of, classes, befores, afters, ids = bucket_repeats(entries, length)
        contexts = c.unpacked(entries.column("contexts"), np.uint64)
        blocks = np.repeat(entries.column("block").to_numpy(), [len(x) // 8 for x in entries.column("contexts").to_pylist()])
        order = np.argsort(classes, kind="stable")
        classes, befores, afters, ids = classes[order], befores[order], afters[order], ids[order]
        if widest and len(classes):
            at = c.runs(classes)
            classes, befores, afters, ids = classes[at], np.maximum.reduceat(befores, at), np.maximum.reduceat(afters, at), ids[at]
        # every entry of a class gets all that was found for the class
        counts = np.bincount(classes, minlength=int(class_of.max(initial=-1)) + 1)
        begins = np.cumsum(counts) - counts
        times = counts[class_of]
        entry = np.repeat(np.arange(len(class_of)), times)
        which = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times) + begins[class_of][entry]
        names = ("contexts", "lefts", "rights", "repeats")
        values = (contexts[entry], befores[which].astype(np.uint16), afters[which].astype(np.uint16), ids[which].astype(np.uint64))
        rows = [{"block": x.pop("owner")} | x for x in c.packed(names, blocks[entry], *values)]
        return pa.Table.from_pylist(rows + _window_replies(table.filter(alone)), schema=_REPLIES)

    return f


def _occurrences(docs: pa.Table, replies: pa.Table, length: int, piece: int):
    """(first row, end row, bytes, offsets, starts, ends, repeats) of the occurrences in each run of whole texts."""
    names = ("contexts", "lefts", "rights", "repeats")
    contexts, lefts, rights, repeats = (c.unpacked(replies.column(x), t) for x, t in zip(names, (np.uint64, np.uint16, np.uint16, np.uint64), strict=True))
    order = np.argsort(contexts, kind="stable")
    contexts, lefts, rights, repeats = contexts[order], lefts[order].astype(np.int64), rights[order].astype(np.int64), repeats[order]
    windows, grams = (np.sort(c.unpacked(replies.column(x), np.uint64)) for x in ("windows", "grams"))
    data, offsets = c.text_bytes(docs.column("text"))

    def of_part(begin: int, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = Anchors(part, at, length)
        starts, own_names, _ = a.windows(c.is_member(a.keys, grams), length)
        again = c.is_member(own_names, windows)
        starts, own_names = starts[again], own_names[again]
        own = a.contexts(length)
        lo, hi = np.searchsorted(contexts, own), np.searchsorted(contexts, own, side="right")
        times = hi - lo
        which = np.repeat(np.arange(len(own)), times)
        reply = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + lo[which]
        begins = np.concatenate([a.place[which] - lefts[reply], starts]) + begin
        ends = np.concatenate([a.place[which] + rights[reply], starts + length]) + begin
        return begins, ends, np.concatenate([repeats[reply], own_names])

    for first, end, parts in pieces(data, offsets, length, piece):
        begins, ends, names = (np.concatenate(x) for x in zip(*[of_part(*part) for part in parts], strict=True))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], begins, ends, names


def spans(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of the intervals, in order; those that touch are one, but not over texts."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    text = np.searchsorted(at, starts, side="right")
    new = np.flatnonzero(np.concatenate(([True], (starts[1:] > ends[:-1]) | (text[1:] != text[:-1]))))
    return starts[new], ends[np.append(new[1:], len(ends)) - 1]


def _results(length: int, piece: int):
    def f(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"doc_id": docs.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for first, end, run, at, starts, ends, _ in _occurrences(docs, replies, length, piece):
            starts, ends = spans(starts, ends, at)
            bounds = np.searchsorted(starts, at).tolist()
            raw, at = memoryview(np.ascontiguousarray(run)), at.tolist()
            for i in range(end - first):
                kept, place, removed = hashlib.sha256(), at[i], 0
                for s, e in zip(starts[bounds[i] : bounds[i + 1]].tolist(), ends[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                    kept.update(raw[place:s])
                    place, removed = e, removed + e - s
                kept.update(raw[place : at[i + 1]])
                out["n_bytes"].append(at[i + 1] - at[i])
                out["n_removed"].append(removed)
                out["n_spans"].append(bounds[i + 1] - bounds[i])
                out["kept_sha256"].append(kept.hexdigest())
        return pa.table(out, schema=_RESULT)

    return f


def _listed(length: int, piece: int):
    def f(docs: pa.Table, replies: pa.Table) -> pa.Table:
        tables = []
        ids = docs.column("doc_id").combine_chunks()
        for first, _, _, at, starts, ends, repeats in _occurrences(docs, replies, length, piece):
            text = np.searchsorted(at, starts, side="right") - 1
            tables.append(
                pa.table(
                    [repeats.view(np.int64), ends - starts, ids.take(pa.array(first + text)), starts - at[text]],
                    schema=_OCCURRENCES,
                )
            )
        return pa.concat_tables(tables) if tables else pa.Table.from_pylist([], schema=_OCCURRENCES)

    return f


def _base_and_replies(docs: DataFrame, length: int, widest: bool) -> tuple[DataFrame, DataFrame]:
    n = c.block_count(docs)
    base = c.in_blocks(docs, n)
    survivors = c.by_block(base, _anchor_entries(length, n, PIECE), ENTRIES).groupBy("owner").applyInArrow(_repeated(FREQUENT), SURVIVORS)
    contexts = c.by_block_with(base, survivors, _context_entries(length, n, PIECE), CONTEXTS)
    return base, contexts.groupBy("owner").applyInArrow(_reply(length, widest), REPLIES)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the hash of the kept bytes.

    A byte goes if a string of `length` bytes over it also starts anywhere else.
    """
    base, replies = _base_and_replies(docs, length, widest=True)
    return c.by_block_with(base, replies, _results(length, PIECE), RESULT)


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every occurrence of every maximal repeat around an anchor: repeat_id, length, doc_id, start byte."""
    base, replies = _base_and_replies(docs, length, widest=False)
    return c.by_block_with(base, replies, _listed(length, PIECE), OCCURRENCES)
