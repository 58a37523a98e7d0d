"""Tokenising and sum-of-squares packing.

1. `pieces`: every document becomes its token ids and the end id; documents over
   the capacity are cut into full pieces, with the shorter piece first.
2. `pack`: full pieces fill a sequence each. The others are dealt to shards of
   about SHARD_PIECES by a hash; each shard packs its pieces, longest first: a
   piece goes where the sum over all gaps of the squared number of open sequences
   with that gap becomes smallest. A new sequence is begun only where the piece
   fits no open one: longest first, that packs tighter than weighing a new one too.
3. Sequences that a shard leaves with a wide gap are taken as pieces of a second
   round over fewer shards, so that shards lose almost nothing against one packer.

Only ids' checksums and lengths travel, no texts. A shard has a bounded number of
pieces, whatever the corpus or its sources. Null text is empty: a piece with the
end id alone. Repeated rows are packed each by themselves. Empty table: no rows.

The vocabulary is read from the tokenizer's own file. Its merges have the order of
its ids, so the same ids come out of a byte-pair encoder that takes ids as ranks,
at several times the speed; tests hold them against the file's own library.
The file's added tokens are found in a text as that library finds them by default:
their strings become their ids, and the text between is encoded by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

CAPACITY, END_ID = 1024, 2
SHARD_PIECES = 1 << 16
WIDE_GAP = 8  # sequences with at least so much room go into the second round
# Fixed value: the splitting pattern of this byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printed_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. `ids` takes a text as ordinary text, `ids_with_added` finds the file's added tokens in it."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {x["content"] for x in made.get("added_tokens", [])}
        byte = printed_bytes()
        ranks = {bytes(byte[c] for c in token): rank for token, rank in made["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        added = made.get("added_tokens", [])
        if odd := [x["content"] for x in added if x["single_word"] or x["lstrip"] or x["rstrip"]]:
            raise ValueError(f"added tokens that take white space or whole words only: {odd}")
        self.added = {x["content"]: x["id"] for x in added if x["content"]}
        # leftmost, and of several at one place the longest
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def ids_with_added(self, text: str) -> bytes:
        if not self.between:
            return self.ids(text)
        parts = self.between.split(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if k % 2 else self.ids(x) for k, x in enumerate(parts))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in common.slices(batch):
                row, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    ids = (encoder.ids_with_added(text) if text else b"") + end
                    n = len(ids) // 4
                    a, i = 0, 0
                    while a < n:
                        b = a + ((n - a) % capacity or capacity) if i == 0 else a + capacity
                        row.append(k)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                        a, i = b, i + 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence number of each piece, longest pieces first."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gap 0 is closed and does not count
    out = np.zeros(len(lengths), np.int64)
    used = 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        gap = capacity
        if size < capacity:
            # change of the sum when a sequence of gap g takes the piece: -2 N(g) + 1 + 2 N(g - size) + 1
            after = count[: capacity + 1 - size]
            change = 2 * (after[: capacity - size] - count[size:capacity]) + 2
            change[0] -= 1  # filled: gap 0 has no square of its own
            change[count[size:capacity] == 0] = 1 << 40
            best = int(change.argmin()) if len(change) else 0
            if len(change) and change[best] < 1 << 39:
                gap = best + size
        if gap == capacity:
            at, used = used, used + 1
        else:
            at = open_by_gap[gap].pop()
            count[gap] -= 1
        out[k] = at
        if gap > size:
            open_by_gap[gap - size].append(at)
            count[gap - size] += 1
    return out


def _offsets(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Place of each piece in its sequence, in the order given."""
    order = np.argsort(seq, kind="stable")
    total = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, seq[order][1:] != seq[order][:-1]] if len(seq) else np.zeros(0, bool)
    out = np.zeros(len(seq), np.int64)
    out[order] = total - np.repeat(total[first], np.diff(np.r_[np.flatnonzero(first), len(seq)]))
    return out


def _shard_packer(key: str, name: str, place: str, capacity: int):
    """Packs one shard's rows; sequence numbers are the shard's number and a running one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in rows.column_names if c in ("doc_id", "piece", "start", "bin")])
        length = rows.column("size").to_numpy()
        seq = sum_of_squares(length, capacity)
        shard = rows.column(key).to_numpy()[0] if len(length) else 0
        return rows.append_column(name, pa.array((np.int64(shard) << 32) | seq)).append_column(place, pa.array(_offsets(seq, length)))

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = cut.sparkSession
    cut = common.checkpoint(cut.withColumn("size", F.col("length")))
    short = cut.where(F.col("length") < capacity)
    n = short.count()
    shards = max(1, -(-n // SHARD_PIECES))
    first = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), F.lit(shards)).cast("long"))
    schema = first.schema.simpleString()[len("struct<") : -1]
    packed = first.groupBy("shard").applyInArrow(_shard_packer("shard", "bin", "place", capacity), f"{schema}, bin long, place long")
    if shards == 1:
        done = packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    else:
        packed = common.checkpoint(packed)
        bins = packed.groupBy("bin").agg(F.sum("length").alias("size"))
        wide = bins.where(F.col("size") <= capacity - WIDE_GAP)
        fewer = max(1, -(-wide.count() // SHARD_PIECES))
        again = wide.withColumn("shard", F.pmod(F.xxhash64("bin", F.lit(2)), F.lit(fewer)).cast("long")).groupBy("shard").applyInArrow(_shard_packer("shard", "whole", "base", capacity), "bin long, size long, shard long, whole long, base long")
        joined = packed.join(again.select("bin", "whole", "base"), "bin", "left")
        # bins of the second round get odd numbers, the others even ones
        number = F.coalesce(F.col("whole") * 2 + 1, F.col("bin") * 2)
        done = joined.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), (F.coalesce("base", F.lit(0)) + F.col("place")).alias("offset"))
    full = cut.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return done.unionByName(full)


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents"), default_tokenizer())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents it is given."""
    return best_fit(docs, default_tokenizer())
