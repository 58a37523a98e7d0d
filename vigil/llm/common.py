"""Helpers shared by the text operators: splitting, hashing and checkpointing.

Everything here works on one bounded slice of an Arrow batch at a time.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20  # text handled at once by numpy code
ARROW_ROWS = 2000  # rows of an Arrow batch; texts can be long
GROUP_BYTES = 8 << 20  # text aimed at for one group of documents

ODD = np.uint64(0x9E3779B97F4A7C15)
BYTE_SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1342543DE82EF95))  # two unrelated names a word

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark: SparkSession) -> None:
    """Arrow batches of a few thousand rows: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, in the cluster's shared folder (spark.checkpoint.dir). Only a local master may do without the setting: its one machine then gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", "")
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: columns can be pruned, and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as remainder -1, so it is neither held out nor special."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by, F.lit(-1))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch into row ranges of about SLICE_BYTES of text (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE_BYTES
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True bytes within a document, and per document the index of its first run."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for spans that do not overlap, in order: the sum of a scrambled number for each (place, byte).

    Unlike a polynomial modulo 2**64, no structure of a text (periods, alternating
    blocks) makes two texts agree: every (place, byte) has a number of its own.
    """
    size = end - start
    total = int(size.sum())
    if not total:
        return np.zeros(len(start), np.uint64)
    place = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    each = mixed(((place.astype(np.uint64) << np.uint64(8)) | data[np.repeat(start, size) + place]) * ODD + BYTE_SEEDS[seed])
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(each, out=sums[1:])
    last = np.cumsum(size)
    return mixed((sums[last] - sums[last - size]) ^ size.astype(np.uint64))


def chained(values: np.ndarray, start: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of values[i:i+width] for each i in start, by a chain of scrambling steps."""
    key = np.full(len(start), BYTE_SEEDS[seed] + np.uint64(width))
    for j in range(width):
        key = mixed(key * ODD + values[start + j])
    return key


def hashed_words(column: pa.Array, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of words split at ASCII white space, first word of each document, byte span of each word."""
    data, offsets = utf8(column)
    start, end, first = runs(~SPACE[data], offsets)
    return byte_hashes(LOWER[data] if lower else data, start, end, seed), first, start, end


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of words[i:i+width] for each i where it fits the array; callers leave out those that cross documents."""
    return chained(words, np.arange(max(len(words) - width + 1, 0)), width, seed)


def inside_documents(first: np.ndarray, width: int) -> np.ndarray:
    """Start indexes of the windows of so many words that lie in one document."""
    count = np.diff(first)
    room = np.maximum(count - width + 1, 0)
    total = int(room.sum())
    return np.arange(total) - np.repeat(np.cumsum(room) - room, room) + np.repeat(first[:-1], room)


def groups_for(spark: SparkSession, size: int, least: int = 1) -> int:
    """How many groups of documents: by bytes of text, at least the shuffle partitions, so it follows the input and the cluster."""
    return int(max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES)))


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
