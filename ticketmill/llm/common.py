"""What the document operators share: reading, stored steps, blocks of documents and packed keys.

Blocks. A document belongs to block ``hash(doc_id) % n``; n follows the bytes of all texts, so a
block holds about BLOCK_BYTES of text whatever the size of the input. Python sees one block at a
time. A key (a hash) belongs to one of as many buckets. Keys travel packed: one row for a block
and a bucket, with the keys as bytes. A block sends each of its keys once, so a key that a third
of all documents hold reaches its bucket once a block, not once a document.
"""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 17  # arrays of 8 bytes for each byte of a slice stay in a core's cache
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which it does once the driver has collected what refers to them.

    For the one or two places of an operator where large files would else lie beside the next ones.
    """
    gc.collect()
    time.sleep(1.5)  # Python's references go to the driver's JVM once a second
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here removes its shuffle files at its end; else they lie until the driver collects
    its garbage, and those of the last execution until there is another one."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(frame: DataFrame) -> DataFrame:
    """The rows written once under the checkpoint folder and read back, which cuts the lineage."""
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    schema = frame.schema
    frame.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column is read or shuffled, whatever its name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_id() -> Column:
    """doc_id, or for null a number from the text that lies above ids in use, so that each text has one."""
    beyond = F.lit(np.iinfo(np.int64).max) - F.pmod(F.xxhash64("text"), F.lit(1 << 44))
    return F.coalesce(F.col("doc_id").cast("long"), beyond)


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text `keep` is true for, with all their columns and without a shuffle."""
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(f, docs.schema)


def block_count(docs: DataFrame) -> int:
    """Blocks for these texts: one for each BLOCK_BYTES, and no fewer than the shuffle has partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BLOCK_BYTES))


def in_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """doc_id, text and block, dealt out by block. Every pass over it can reuse this exchange."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block")
    return texts_of(docs).select("doc_id", "text", block).repartition(n_blocks, "block")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and len+1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def id_values(column: pa.Array) -> np.ndarray:
    """doc_id as int64; a null id counts as the largest value, so it is nobody's earlier document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of the public SplitMix64 generator."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values() -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUES = _byte_values()
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << max(n - 1, 1).bit_length())
        have = np.full(size, base & ((1 << 64) - 1), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD_VALUES = np.where(SPACE, np.uint64(0), BYTE_VALUES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte positions) and text numbers of the words of texts lying end to end."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; what lies between words counts as nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = WORD_VALUES[data]
    terms *= powers(BASE, len(data))
    return mixed(np.add.reduceat(terms, starts) * powers(BASE_INVERSE, len(data))[starts])


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k units from each position on (len - k + 1 of them)."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = units[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xAF251AF3B0F025B5)
        out += units[j : j + n]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each position on."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """The starts of runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def run_bounds(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    starts = runs(sorted_values)
    yield from zip(starts, np.append(starts, len(sorted_values))[1:], strict=True)


def is_member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(17)) % np.uint64(n_buckets)).astype(np.int64)


def packed(names: tuple[str, ...], owner: np.ndarray, *columns: np.ndarray) -> Iterator[dict]:
    """One row for each owner (a bucket or block) with the columns' values of that owner as bytes."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    columns = [c[order] for c in columns]
    for s, e in run_bounds(owner):
        yield {"owner": int(owner[s])} | {name: c[s:e].tobytes() for name, c in zip(names, columns, strict=True)}


def unpacked(column, dtype) -> np.ndarray:
    """The values of all rows of a binary column, end to end."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def by_block(frame: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return frame.groupBy("block").applyInArrow(f, schema)


def by_block_with(frame: DataFrame, replies: DataFrame, f, schema: str) -> DataFrame:
    """f sees a block's documents and the replies to that block."""
    return frame.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(f, schema)
