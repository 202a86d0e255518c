"""SimHash near-dedup: fingerprints of word shingles, compared exactly in tiles.

Equal fingerprints are one. Two fingerprints that differ in at most `radius` of 64 bits agree in
at least p - radius of p parts of the bits, so only fingerprints with an equal choice of parts
meet: that choice and its value address a tile. p follows the number of fingerprints, so tiles
stay small at any size; a tile with more than TILE fingerprints is dealt out as pairs of smaller
tiles. A tile is compared with numpy exclusive-or and bit counts in order of population count;
tile pairs (and pairs in small tiles) whose counts differ beyond the radius are skipped. Each tile
returns links that span what it connects, not all pairs, and star contraction joins them.

Results for odd input: null, empty and blank texts have fingerprint zero and link like any other;
one or two words are one shingle; repeated rows of a doc_id share its row's result; a null doc_id
is in its fingerprint's component but never names it unless no other is there (then null); extra
columns are ignored. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm import common as c
from ticketmill.llm.components import components

WORDS = 3
RADIUS = 3
SEED = 42
TILE = 2048
SMALL = 48
BITS = 64

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: bytes, size: int) -> list[int]:
    units = text.lower().split()
    if not units:
        return []
    joined = b" ".join(units)
    if len(units) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, units), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], size: int) -> np.ndarray:
    """A 64-bit fingerprint for each text, as int64."""
    hashes = [shingle_hashes(t, size) for t in texts]
    counts = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
        starts = np.cumsum(counts[full]) - counts[full]
        for byte in range(8):
            ones = np.unpackbits(((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            set_ = np.add.reduceat(ones, starts, axis=0, dtype=np.int32) * 2 > counts[full][:, None]
            out[full] |= np.packbits(set_, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out.view(np.int64)


def _fingerprint_batches(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = c.text_bytes(batch.column(1))
            bits = []
            for first, end, part, at in c.slices(data, offsets):
                raw = part.tobytes()
                bits.append(fingerprints_of([raw[at[i] : at[i + 1]] for i in range(end - first)], size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(bits or [np.zeros(0, np.int64)]))], schema=_FINGERPRINTS)

    return f


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id and bits (the fingerprint as a long)."""
    return c.texts_of(docs).mapInArrow(_fingerprint_batches(size), "doc_id long, bits long")


def addresses(n: int, radius: int) -> list[int]:
    """Bit masks of which two near fingerprints agree on at least one; wider for more fingerprints."""
    parts = radius + 1
    while parts < 2 * radius + 2 and n > 256 << (BITS * (parts - radius) // parts):
        parts += 1
    cuts = [BITS * i // parts for i in range(parts + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(parts)]
    return [sum(x) for x in combinations(masks, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _small_links(bits: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near rows within runs; ends: each row's end of run; rows of a run lie in order of population count."""
    pops = np.bitwise_count(bits).astype(np.int64)
    rows, step = np.arange(len(bits)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < ends[rows]]
        rows = rows[pops[rows + step] - pops[rows] <= radius]
        near = np.bitwise_count(bits[rows] ^ bits[rows + step]) <= radius
        yield rows[near], rows[near] + step


def _tile_labels(bits: np.ndarray, radius: int, side: int = 512) -> np.ndarray:
    """For each row of a large tile the first row of what it is connected to in this tile."""
    pops = np.bitwise_count(bits).astype(np.int64)
    labels = np.arange(len(bits))
    tiles = [(s, min(s + side, len(bits))) for s in range(0, len(bits), side)]
    pairs = [(a, b) for i, a in enumerate(tiles) for b in tiles[i:] if pops[b[0]] - pops[a[1] - 1] <= radius]
    while True:
        before = labels.copy()
        for (s, e), (t, u) in pairs:
            near = np.bitwise_count(bits[s:e, None] ^ bits[None, t:u]) <= radius
            labels[s:e] = np.minimum(labels[s:e], np.where(near, labels[None, t:u], len(bits)).min(axis=1))
            labels[t:u] = np.minimum(labels[t:u], np.where(near, labels[s:e, None], len(bits)).min(axis=0))
        while (labels != labels[labels]).any():
            labels = labels[labels]
        if (labels == before).all():
            return labels


def _tile_links(radius: int):
    """Rows (tile, bits, node), a tile's rows together, become links between nodes."""

    def links(tile: np.ndarray, bits: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((np.bitwise_count(bits), tile))
        # rows of one tile stay one run: tiles are numbered in order of their first row
        bits, node, tile = bits[order], node[order], tile[order]
        starts = c.runs(tile)
        ends = np.append(starts[1:], len(tile))
        sizes = ends - starts
        small = np.repeat(sizes <= SMALL, sizes)
        at = np.flatnonzero(small)
        small_ends = np.searchsorted(at, np.repeat(ends, sizes)[at])
        found = [(at[a], at[b]) for a, b in _small_links(bits[at], small_ends, radius)]
        for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
            labels = _tile_labels(bits[s:e], radius)
            moved = np.flatnonzero(labels != np.arange(e - s))
            found.append((s + moved, s + labels[moved]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], schema=_LINKS)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[0]):
                continue
            *key, bits, node = columns
            new = np.zeros(len(bits), bool)
            new[0] = True
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield from links(np.cumsum(new)[:cut], bits[:cut].view(np.uint64), node[:cut])
            kept = [x[cut:] for x in columns]
        if kept is not None:
            yield from links(np.zeros(len(kept[0]), np.int64), kept[-2].view(np.uint64), kept[-1])

    return f


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all rows (bits, node) whose bits differ in at most `radius` places."""
    masks = addresses(marks.count(), radius)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)]))
    rows = marks.select("bits", "node", choice.alias("of")).select(
        "bits", "node", F.col("of.choice").alias("choice"), F.col("bits").bitwiseAND(F.col("of.mask")).alias("value")
    )
    large = rows.groupBy("choice", "value").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).filter("tiles > 1")
    own = F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int")
    dealt = (
        rows.join(large, ["choice", "value"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("choice", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bits", "node")
    )
    key = ["choice", "value", "i", "j"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_tile_links(radius), "a long, b long")


def simhash_dedup(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    prints = c.stored(fingerprints(docs, size))
    nodes = c.stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    # nodes are fingerprints, so that those without any doc_id still link
    found = components(near_links(nodes.select("bits", F.col("bits").alias("node")), radius))
    named = nodes.join(found, nodes["bits"] == found["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(ids, "component").select("bits", "component_id")
    return prints.join(names, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), BITS // 4, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents of the smallest doc_id of each component, one row for each, with all their columns."""
    found = simhash_dedup(docs.select(c.row_id().alias("doc_id"), "text"), size, radius)
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stays")).distinct()
    rows = docs.withColumn("row_id_", c.row_id())
    return rows.join(stay, F.col("row_id_") == F.col("stays"), "left_semi").dropDuplicates(["row_id_"]).drop("row_id_")
