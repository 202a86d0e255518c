"""Line dedup: an exact set-similarity join of lines, which keeps the first of similar lines.

A line is the set of its words. Lines with the same set are one; two sets match at Jaccard
THRESHOLD or more. Every line orders its words by rarity: by a count of the word over all lines in
a table of fixed size (COUNTERS), then by hash, so the order is the same everywhere. Matching sets
share a word among their rarest (the prefix), unless the word occurs once, so only those words are
sent: lines meet by word, and a pair is a candidate if its lengths allow the threshold, the places
of the shared word leave enough words for it, and parity bitmaps of the words do not exclude it.
Words that more than TILE sets send, or that are counted more
than FREQUENT times, are dealt out as pairs of tiles instead. A pair is verified on the whole
sets, where both meet: each set has ROUTES MinHash values, equal in most near sets, and the first
that is equal in both names the bucket, so a set travels to few buckets however many partners it
has (pairs without an equal one meet in a bucket that found them). A bucket with very many pairs, as
those of a large group of near copies, is verified in parts, each with some of the pairs' first sets.
Pairs travel packed and end in their bucket, which returns for each set the number of its links and its earliest partner. A line goes if a line before it, by (doc_id, line number), matches; lines are
judged on the input, so a line may go for one that goes itself.

Words are those between blanks, unchanged; lines are cut at line feeds. Results for odd input:
lines without words stay and match nothing; null texts are empty; repeated rows of a doc_id are
one place, so neither makes the other go; rows that share a doc_id but not the text, and null
doc_ids (after all others), are told apart by their text; an empty table gives no rows; other
columns pass through, but for those with a name that this operator returns; very long lines and
texts are processed whole. Each pair of different matching lines is a link and is verified, so time
grows with the square of a group of near copies, and its pairs are stored, some 16 bytes each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c

THRESHOLD = 0.8
COUNTERS = 1 << 20
TILE = 1024
PAIRS = 250_000  # about so many pairs are verified at once
FLUSH = 500_000
FREQUENT = 100_000  # entries of words counted more often do not gather by word at all
LAST = int(np.iinfo(np.int64).max)

LINES = "key long, doc_id long, mark long, line int"
LONGEST = (1 << 16) - 1  # sizes and places of words travel in two bytes; lines of more words pass those filters

# What travels: kind 0, prefix entries of a bucket or candidate pairs; kind 1, lines; kind 2, entries of a word that
# many sets send, to be dealt out as tiles. Columns are packed.
NAMES = ("c0", "c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8")
PACKED = "kind int, owner long, " + ", ".join(f"{x} binary" for x in NAMES)
_PACKED = pa.schema([("kind", pa.int32()), ("owner", pa.int64())] + [(x, pa.binary()) for x in NAMES])
ROUTES = 3
# word, set, size, place, two words of parity bits, routes
ENTRY = (np.uint64, np.uint64, np.uint16, np.uint16, np.uint64, np.uint64, *[np.uint16] * ROUTES)
LINE = (np.uint64, np.int64, np.int64, np.int32)  # set, doc_id, mark, line

ADDED = ("n_lines", "n_removed", "n_links", "first_doc")


class Sets:
    """The words of all lines of some texts lying end to end; lines without words are left out."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, _, text = c.words(data, offsets)
        self.hashes = c.word_hashes(data, starts)
        feeds = np.concatenate(([0], np.cumsum(data == 10)))
        self.number = feeds[starts] - feeds[offsets[text]]
        self.text = text
        new = np.ones(len(text), bool)
        if len(text):
            new[1:] = (text[1:] != text[:-1]) | (self.number[1:] != self.number[:-1])
        self.line = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of all words, in one row for each sixteenth of the table."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        data, offsets = c.text_bytes(batch.column(1))
        slots = [np.zeros(0, np.int32)]
        for _, _, part, at in c.slices(data, offsets):
            starts, _, _ = c.words(part, at)
            slots.append((c.word_hashes(part, starts) & np.uint64(COUNTERS - 1)).astype(np.int32))
        counts += np.bincount(np.concatenate(slots), minlength=COUNTERS)
    share = COUNTERS // 16
    if counts.any():
        rows = [{"part": i, "counts": counts[i * share : (i + 1) * share].astype(np.int32).tobytes()} for i in range(16)]
        yield c.to_batch(rows, pa.schema([("part", pa.int32()), ("counts", pa.binary())]))


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // 16, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int32)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": [np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()]})


def word_counts(texts: DataFrame) -> np.ndarray:
    """The fixed-size table of word counts over all lines (4 MB, whatever the corpus)."""
    with c.shuffles_dropped(texts.sparkSession):
        rows = texts.mapInArrow(_word_counts, "part int, counts binary").groupBy("part").applyInArrow(_sum_counts, "part int, counts binary").collect()
    out = np.zeros(COUNTERS, np.int32)
    for r in rows:
        out[r.part * (COUNTERS // 16) : (r.part + 1) * (COUNTERS // 16)] = np.frombuffer(r.counts, np.int32)
    return out


# Multipliers of the MinHash values, whose lower two bytes name a route.
SEEDS = c.mixed(np.arange(1, ROUTES + 1, dtype=np.uint64)) | np.uint64(1)


def _prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _in_order(line: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by line, then count, then hash: by one number that holds most of it, or in full where that ties."""
    bits = int(line[-1]).bit_length() if len(line) else 0
    short = np.minimum(count, np.uint64((1 << 20) - 1)) << np.uint64(44 - bits) | hashes >> np.uint64(20 + bits)
    one = (line.astype(np.uint64) << np.uint64(64 - bits) if bits else np.uint64(0)) | short
    order = np.argsort(one)
    at = np.flatnonzero(one[order][1:] == one[order][:-1])
    if (hashes[order[at]] != hashes[order[at + 1]]).any():
        return np.lexsort((hashes, count, line))
    return order


def _entries_of(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, threshold: float, frequent: int = FREQUENT):
    """(line keys, text, line number), and the prefix entries of the slice's distinct sets."""
    s = Sets(data, offsets)
    count = np.minimum(counts[(s.hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)
    order = _in_order(s.line, count, s.hashes)
    line, count, hashes = s.line[order], count[order], s.hashes[order]
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    line, count, hashes = line[keep], count[keep], hashes[keep]
    n = len(s.first)
    starts = np.searchsorted(line, np.arange(n))
    sizes = np.diff(np.append(starts, len(line)))
    if n:
        keys = c.mixed(np.add.reduceat(c.mixed(hashes + np.uint64(1)), starts) ^ sizes.astype(np.uint64))
        bit, side = np.uint64(1) << (hashes >> np.uint64(3) & np.uint64(63)), (hashes >> np.uint64(9) & np.uint64(1)) > 0
        parity = [np.bitwise_xor.reduceat(np.where(side == odd, bit, np.uint64(0)), starts) for odd in (False, True)]
        routes = [(np.minimum.reduceat(hashes * seed, starts) & np.uint64(LONGEST)).astype(np.uint16) for seed in SEEDS]
    else:
        keys = np.zeros(0, np.uint64)
        parity, routes = [keys] * 2, [np.zeros(0, np.uint16)] * ROUTES
    _, once = np.unique(keys, return_index=True)
    chosen = np.zeros(n, bool)
    chosen[once] = True
    place = np.arange(len(line)) - starts[line]
    sent = chosen[line] & (place < _prefix(sizes, threshold)[line]) & (count > 1)
    of = line[sent]
    word = count[sent] << np.uint64(44) | hashes[sent] >> np.uint64(20)
    short = [np.minimum(x, LONGEST).astype(np.uint16) for x in (sizes[of], place[sent])]
    return keys, s.text[s.first], s.number[s.first], (word, keys[of], *short, *(x[of] for x in parity), *(x[of] for x in routes), count[sent] > frequent)


def _once(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in order of the first two columns, of equal ones in those the first."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return [x[new] for x in columns]


def _rows(kind: int, owner: np.ndarray, *columns: np.ndarray) -> list[dict]:
    return [x | {"kind": kind} for x in c.packed(NAMES[: len(columns)], owner, *columns)]


def _pack(counts: np.ndarray, threshold: float, n_buckets: int, frequent: int):
    """The prefix entries of a batch by bucket, and its lines with their keys."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.text_bytes(batch.column(1))
            ids, marks = c.id_values(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            parts, lines = [], []
            for first, _, part, at in c.slices(data, offsets):
                keys, text, number, entries = _entries_of(part, at, counts, threshold, frequent)
                parts.append(entries)
                lines.append((keys, ids[first + text], marks[first + text], number.astype(np.int32)))
            if not parts:
                continue
            *entries, often = _once([np.concatenate(x) for x in zip(*parts, strict=True)])
            seldom = [x[~often] for x in entries]
            rows = _rows(0, c.bucket_of(c.mixed(seldom[0]), n_buckets), *seldom)
            often = [x[often] for x in entries]
            rows += _rows(2, c.bucket_of(often[1], n_buckets), *often)
            columns = [np.concatenate(x) for x in zip(*lines, strict=True)]
            rows += _rows(1, c.bucket_of(columns[0][:1], n_buckets).repeat(len(columns[0])), *columns)
            yield c.to_batch(rows, _PACKED)

    return f


def _of_kind(table: pa.Table | pa.RecordBatch, kind: int, types: tuple) -> list[np.ndarray]:
    table = table.filter(pa.array(np.asarray(table.column("kind")) == kind))
    return [c.unpacked(table.column(name), t) for name, t in zip(NAMES, types, strict=False)]


def _unpack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = _of_kind(batch, 1, LINE)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names=["key", "doc_id", "mark", "line"])


def _pairs_of(columns: list[np.ndarray], threshold: float, owner: int, n_buckets: int) -> list[np.ndarray]:
    """Candidate pairs (a, b, bucket that verifies) of entries with equal words, by length, place and bitmap."""
    order = np.lexsort((columns[2], columns[0]))
    group, keys, sizes, places, even, odd, *routes = (x[order] for x in columns)
    sizes, places, routes = sizes.astype(np.int64), places.astype(np.int64), [x.astype(np.int64) for x in routes]
    ends = np.repeat(*_run_ends(group))
    rows, step, found, held = np.arange(len(group)), 0, [], 0
    while len(rows):
        step += 1
        rows = rows[rows + step < ends[rows]]
        other = rows + step
        # sizes ascend within a group, so a row whose next is too long is done
        fit = sizes[rows] >= threshold * sizes[other] - 1e-9
        rows, other = rows[fit], other[fit]
        need = np.ceil(threshold / (1 + threshold) * (sizes[rows] + sizes[other]) - 1e-9)
        left = np.minimum(places[rows], places[other]) + np.minimum(sizes[rows] - places[rows], sizes[other] - places[other])
        differ = np.bitwise_count(even[rows] ^ even[other]).astype(np.int64) + np.bitwise_count(odd[rows] ^ odd[other])
        ok = (left >= need) & (differ <= sizes[rows] + sizes[other] - 2 * need) | (sizes[other] >= LONGEST)
        ok &= keys[rows] != keys[other]
        x, y = rows[ok], other[ok]
        meet = np.full(len(x), n_buckets + owner)
        for route in reversed(routes):
            meet = np.where(route[x] == route[y], route[x] % n_buckets, meet)
        found.append((np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y]), meet.astype(np.int32)))
        held += len(x)
        if held > FLUSH:  # a pair that two words find need not meet itself here: _distinct_pairs takes it once
            found, held = [tuple(_once([np.concatenate(x) for x in zip(*found, strict=True)]))], 0
    if not found:
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
    return _once([np.concatenate(x) for x in zip(*found, strict=True)])


def _run_ends(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of each run of equal values, and its length."""
    starts = c.runs(group)
    ends = np.append(starts, len(group))[1:]
    return ends, ends - starts


def _bucket_pairs(threshold: float, n_buckets: int):
    """Candidate pairs of a bucket's words, entries of words with more than TILE sets, and the other kinds as they came."""

    def f(table: pa.Table) -> pa.Table:
        columns = _once(_of_kind(table, 0, ENTRY))
        words = columns[0]
        _, times = _run_ends(words)
        each = np.repeat(times, times)
        some, hot = (each > 1) & (each <= TILE), each > TILE
        owner = table.column("owner")[0].as_py()
        a, b, meet = _pairs_of([x[some] for x in columns], threshold, owner, n_buckets)
        rows = _rows(0, c.bucket_of(a, n_buckets), a, b, meet)
        rows += _rows(2, np.zeros(int(hot.sum()), np.int64), *(x[hot] for x in columns))
        found = pa.Table.from_pylist(rows, schema=_PACKED)
        others = table.filter(pa.array(np.asarray(table.column("kind")) != 0)).select(_PACKED.names)
        return pa.concat_tables([found, others.cast(_PACKED)])

    return f


HOT = ("word", "key", "size", "place", "even", "odd", *[f"route{i}" for i in range(ROUTES)])
HOT_TYPES = ("long", "long", "int", "int", "long", "long", *["int"] * ROUTES)


def _unpack_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32) for x in _of_kind(batch, 2, ENTRY)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=list(HOT))


def _tile_pairs(threshold: float, n_buckets: int):
    def f(table: pa.Table) -> pa.Table:
        columns = [table.column(x).to_numpy() for x in HOT]
        columns = [x.view(np.uint64) if x.dtype == np.int64 else x for x in columns]
        owner = int(c.bucket_of(c.mixed(columns[0][:1]), n_buckets)[0])
        a, b, meet = _pairs_of(columns, threshold, owner, n_buckets)
        return pa.Table.from_pylist(_rows(0, c.bucket_of(a, n_buckets), a, b, meet), schema=_PACKED)

    return f


def _distinct_pairs(n_buckets: int):
    """Each pair once, packed for the bucket that verifies it (of several the first), or for a part of it.

    Each owner sees its share of every bucket's pairs. Where that share says that a bucket has over PAIRS
    of them, they are dealt out to parts of the bucket, so no task verifies all pairs of a group of near copies.
    """

    def f(table: pa.Table) -> pa.Table:
        own = table.column("owner")[0].as_py()
        a, b, meet = _of_kind(table, 0, (np.uint64, np.uint64, np.int32))
        order = np.argsort(meet, kind="stable")
        a, b, meet = _once([a[order], b[order], meet[order]])
        meet = meet.astype(np.int64)
        share = np.bincount(meet)[meet] if len(meet) else meet
        parts = 1 << np.ceil(np.log2(np.maximum(1, share * n_buckets / PAIRS))).astype(np.int64)
        # parts is a power of two, so parts + part names both
        meet = np.where(parts > 1, meet + 2 * n_buckets * (parts + own % parts), meet)
        return pa.Table.from_pylist(_rows(0, meet, a, b), schema=_PACKED)

    return f


def _keys_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of the pairs of each packed row, with the bucket that needs them."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = np.unique(np.frombuffer(batch.column(1)[i].as_py() + batch.column(2)[i].as_py(), np.int64))
            owner = np.full(len(keys), batch.column(0)[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys)], names=["owner", "key"])


def candidate_pairs(found: DataFrame, n_buckets: int, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of set keys that may match, each once, packed by the bucket (owner) that is to verify them."""
    hot = found.filter("kind = 2").mapInArrow(_unpack_hot, ", ".join(map(" ".join, zip(HOT, HOT_TYPES, strict=True))))
    # a set once for each word, then the number of tiles by an aggregate: no word gathers in one task
    hot = hot.dropDuplicates(["word", "key"])
    tiles = hot.groupBy("word").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    hot = hot.join(tiles, "word").withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    hot = hot.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    tiles = hot.groupBy("word", "i", "j").applyInArrow(_tile_pairs(threshold, n_buckets), PACKED)
    return found.filter("kind = 0").unionByName(tiles).groupBy("owner").applyInArrow(_distinct_pairs(n_buckets), PACKED).select("owner", "c0", "c1")


SETS = "owner long, key long, doc_id long, mark long, line int, words binary"
_SETS = pa.schema(
    [("owner", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()), ("words", pa.binary())]
)


def _wanted_sets(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The words (distinct hashes in order) of the lines that buckets ask for."""
    rows = []
    if docs.num_rows and wanted.num_rows:
        place = {}
        ids, marks = c.id_values(docs.column("doc_id")).tolist(), docs.column("mark").to_pylist()
        for i, at in enumerate(zip(ids, marks, strict=True)):
            place.setdefault(at, i)
        texts, cut, known = docs.column("text"), {}, {}
        names = ("owner", "key", "doc_id", "mark", "line")
        for owner, key, doc, mark, line in zip(*(wanted.column(x).to_pylist() for x in names), strict=True):
            if key not in known:
                i = place[doc, mark]
                if i not in cut:
                    cut[i] = texts[i].as_py().encode().split(b"\n")
                data = np.frombuffer(cut[i][line], np.uint8)
                starts, _, _ = c.words(data, np.array([0, len(data)]))
                known[key] = _six_bytes(np.unique(c.word_hashes(data, starts)))
            rows.append({"owner": owner, "key": key, "doc_id": doc, "mark": mark, "line": line, "words": known[key]})
    return pa.Table.from_pylist(rows, schema=_SETS)


def _six_bytes(words: np.ndarray) -> bytes:
    """48 bits of each hash: enough to tell the words of two lines apart, and a quarter less to move."""
    return words.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(sets: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the sets, all their words)."""
    sizes = np.array([len(x) // 6 for x in sets.column("words").to_pylist()], np.int64)
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :6] = c.unpacked(sets.column("words"), np.uint8).reshape(-1, 6)
    return sizes, wide.view(np.uint64)[:, 0]


def _stored(frame: DataFrame) -> DataFrame:
    """A finished step, whose shuffle files (the entries, the texts in blocks) would else lie beside those of the next."""
    with c.shuffles_dropped(frame.sparkSession):
        return c.stored(frame)


LINKS = "key long, links long, doc_id long, line int, mark long"


def _verified(threshold: float):
    """For each set of a bucket's pairs: its links, the pairs whose whole sets match, and its earliest partner's place."""

    def f(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        place = [sets.column(x).to_numpy() for x in ("mark", "line", "doc_id")]
        sets = sets.take(pa.array(np.lexsort(place)))  # so that the least row number is the earliest place
        keys = sets.column("key").to_numpy()
        order = np.argsort(keys)
        sizes, words = _from_six_bytes(sets)
        starts = np.cumsum(sizes) - sizes
        distinct, words = np.unique(words, return_inverse=True)
        a, b = (c.unpacked(pairs.column(x), np.int64) for x in ("c0", "c1"))
        a, b = (order[np.searchsorted(keys, x, sorter=order)] for x in (a, b))
        sort = np.argsort(a, kind="stable")
        a, b = a[sort], b[sort]
        held, keep = np.zeros(len(distinct), bool), np.zeros(len(a), bool)
        for s, e in c.run_bounds(a):
            own = words[starts[a[s]] : starts[a[s]] + sizes[a[s]]]
            held[own] = True
            n = sizes[b[s:e]]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(starts[b[s:e]], n)
            both = np.add.reduceat(held[words[at]], first, dtype=np.int64)
            keep[s:e] = both >= threshold * (len(own) + n - both) - 1e-9
            held[own] = False
        one, other = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
        links = np.bincount(one, minlength=len(keys))
        least = np.full(len(keys), len(keys))
        np.minimum.at(least, one, other)
        linked = np.flatnonzero(links)
        partner = sets.take(pa.array(least[linked])).select(["doc_id", "line", "mark"])
        return pa.table([pa.array(keys[linked]), pa.array(links[linked]), *partner.columns], names=["key", "links", "doc_id", "line", "mark"])

    return f


def _kept(columns: list[str]):
    """The texts without the lines that go; `gone` has a row for each doc_id and mark with lines."""

    def f(docs: pa.Table, gone: pa.Table) -> pa.Table:
        of = {}
        for doc, mark, lines, links, first in zip(*(gone.column(x).to_pylist() for x in ("doc_id", "mark", "lines", "n_links", "first_doc")), strict=True):
            of[doc, mark] = set(lines or ()), links, first
        out = {"text": [], "n_lines": [], "n_removed": [], "n_links": [], "first_doc": []}
        ids, marks = c.id_values(docs.column("doc_id")).tolist(), docs.column("mark").to_pylist()
        for i, (doc, mark) in enumerate(zip(ids, marks, strict=True)):
            lines, links, first = of.get((doc, mark), (frozenset(), 0, None))
            text = docs.column("text")[i].as_py()
            cut = (text or "").split("\n")
            out["n_lines"].append(sum(1 for x in cut if x.strip(" \t\n\x0b\f\r")))
            out["text"].append("\n".join(x for n, x in enumerate(cut) if n not in lines) if lines else text)
            out["n_removed"].append(len(lines))
            out["n_links"].append(links)
            own = docs.column("doc_id")[i].as_py()
            out["first_doc"].append(own if first is None else None if first == LAST else first)
        types = {"text": pa.string()}
        return pa.table({x: pa.array(out[x], types.get(x, pa.int64())) if x in out else docs.column(x) for x in [*columns, *ADDED]})

    return f


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with text less the lines that go, and n_lines (with words), n_removed, n_links
    (different sets that the document's lines match) and first_doc (the smallest doc_id with a line
    that matches one of them; its own if none)."""
    own = {x: f"{x}_{uuid.uuid4().hex}" for x in docs.columns if x in ("mark", "block")}
    docs = docs.withColumnsRenamed(own)
    columns = [x for x in docs.columns if x not in ADDED]
    n = c.block_count(docs)
    docs = docs.select(*columns).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    mark = F.xxhash64("text").alias("mark")
    texts = docs.select("doc_id", "text", mark)
    counts = word_counts(texts)
    entries = texts.mapInArrow(_pack(counts, threshold, n, FREQUENT), PACKED).groupBy("owner")
    found = _stored(entries.applyInArrow(_bucket_pairs(threshold, n), PACKED))
    pairs = _stored(candidate_pairs(found, n, threshold))
    lines = found.filter("kind = 1").mapInArrow(_unpack_lines, LINES)
    place = F.struct("doc_id", "line", "mark")
    firsts = _stored(lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("times")))

    block = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block")
    base = docs.select(*columns, mark, block).repartition(n, "block")
    # null ids were counted as the largest; their blocks are those of null
    block_of = F.pmod(F.xxhash64(F.nullif(F.col("doc_id"), F.lit(LAST))), F.lit(n)).cast("int").alias("block")
    asked = pairs.mapInArrow(_keys_of_pairs, "owner long, key long").distinct().join(firsts, "key")
    asked = asked.select("owner", "key", "first.*").select("owner", "key", "doc_id", "mark", "line", block_of)
    sets = c.by_block_with(base, asked, _wanted_sets, SETS)
    links = _stored(pairs.groupBy("owner").cogroup(sets.groupBy("owner")).applyInArrow(_verified(threshold), LINKS))

    partner = links.groupBy(F.col("key").alias("a")).agg(F.min(place).alias("partner"), F.sum("links").alias("links"))
    earliest = firsts.filter("times > 1").select("key", "first").join(partner, F.col("key") == F.col("a"), "full")
    earliest = earliest.select(
        F.coalesce("key", "a").alias("of"), F.least("first", "partner").alias("earliest"), F.coalesce("links", F.lit(0)).alias("links")
    )
    judged = lines.join(earliest, F.col("key") == F.col("of")).withColumn("goes", F.col("earliest") < place)
    gone = judged.groupBy("doc_id", "mark").agg(
        F.collect_list(F.when(F.col("goes"), F.col("line"))).alias("lines"),
        F.sum("links").cast("long").alias("n_links"),
        F.min(F.when(F.col("goes"), F.col("earliest.doc_id"))).alias("first_doc"),
    )
    gone = gone.select("doc_id", "mark", "lines", "n_links", "first_doc", block_of)
    schema = ", ".join([f"`{x}` {t}" for x, t in docs.select(*columns).dtypes] + [f"{x} long" for x in ADDED])
    return c.by_block_with(base, gone, _kept(columns), schema).withColumnsRenamed({y: x for x, y in own.items()})


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (first_doc), n_lines, n_removed, n_links and the hash of the kept text."""
    kept = dedup_lines(docs.select("doc_id", "text"), threshold)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", F.col("first_doc").alias("class_id"), "n_lines", "n_removed", "n_links", digest)
