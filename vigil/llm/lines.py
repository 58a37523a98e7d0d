"""Line dedup with a sharded minimal perfect hash.

1. Each group of documents sends, for each distinct line key, its 64-bit hash, an
   unrelated 32-bit fingerprint and the number of its documents that hold the key, to
   the shard of the hash's range.
2. A shard builds a minimal perfect hash over its distinct hashes and fills two
   compact arrays at the hash's index: the fingerprint and a saturating 16-bit count.
   The groups' lines then probe the arrays. A line that finds another fingerprint at
   its place is a different line with the same 64-bit hash; such lines are counted
   exactly beside the arrays.
3. What comes back to a group is only its keys found in at least `least` documents;
   documents drop the lines so marked and are put together again.

Lines never join lines; texts move once. Two different lines are taken for one only
where 96 bits agree.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Keys shorter than one character are never dropped. Null or empty text is one empty
line. A document is a doc_id: rows that repeat an id count once for a key they share; a
row without doc_id is a document of its own. A very long text is a group by itself or
with few others, and lines of any length are one key. Empty tables give no rows. Other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import common, grouping

LEAST = 10
SPREAD = 2.0  # bits a key in each level of the perfect hash
TOP = 0xFFFF


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays; a key that is alone in its bit stays, the others go a level deeper."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base, left = 0, keys
        while len(left):
            bits = int(SPREAD * len(left)) | 1
            at = self._place(left, len(self.levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((bits, alone, rank.astype(np.int64)))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.size = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (common.mixed(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) % np.uint64(bits)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for one that no level holds (then it was not built in)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, alone, rank) in enumerate(self.levels):
            at = self._place(keys[left], k, bits)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def _line_keys(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Key hash and fingerprint, whether the key has a character, document, and byte bounds of every line; the bytes."""
    data, offsets = common.utf8(column)
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    doc_of_feed = np.searchsorted(offsets, feeds, "right") - 1
    start = np.concatenate([offsets[:-1], feeds + 1])
    end = np.concatenate([offsets[1:], feeds])
    doc = np.concatenate([np.arange(n), doc_of_feed])
    order = np.argsort(doc[n:], kind="stable")
    # lines of a document: from its start or a feed to the next feed or its end
    start, doc = np.concatenate([start[:n], start[n:][order]]), np.concatenate([doc[:n], doc[n:][order]])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.concatenate([end[n:], end[:n]])
    e_doc = np.concatenate([doc_of_feed, np.arange(n)])
    end = end[np.lexsort((end, e_doc))]
    solid = np.flatnonzero(~common.SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    has = b > a
    k_start = np.where(has, solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else 0, start)
    k_end = np.where(has, solid[np.maximum(b - 1, 0)] + 1 if len(solid) else 0, k_start)
    low = common.LOWER[data]
    mark = (common.byte_hashes(low, k_start, k_end, 1) >> np.uint64(32)).astype(np.uint32)
    return common.byte_hashes(low, k_start, k_end), mark, has, doc, start, end, data


def _parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches(max_chunksize=common.ARROW_ROWS):
        yield from common.slices(batch)


def _identity(table: pa.Table) -> np.ndarray:
    """A number for the document of each row: the same for rows of one id."""
    ids = table.column("doc_id").combine_chunks().dictionary_encode()
    number = pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(number < 0, -1 - np.arange(len(number)), number)


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a group (hash and fingerprint) and the number of its documents that hold each."""
    identity, row, found = _identity(table), 0, []
    for part in _parts(table.select(["text"])):
        key, mark, has, doc, *_ = _line_keys(part.column("text"))
        found.append((key[has], mark[has], identity[row + doc[has]]))
        row += part.num_rows
    key, mark, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    order = np.lexsort((doc, mark, key))
    key, mark, doc = key[order], mark[order], doc[order]
    line = np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])][: len(key)]
    held = line | np.r_[True, doc[1:] != doc[:-1]][: len(key)]
    at = np.flatnonzero(line)
    return key[at], mark[at], np.add.reduceat(held.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def frequent(key: np.ndarray, mark: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Which of a shard's questions (hash, fingerprint, documents of one group) are about lines of at least so many documents."""
    perfect = PerfectHash(np.unique(key))
    fingerprint, count = np.zeros(perfect.size, np.uint32), np.zeros(perfect.size, np.uint16)
    at = perfect.index(key)
    fingerprint[at] = mark  # of several with one hash the last stays
    own = fingerprint[at] == mark
    count[:] = np.minimum(np.bincount(at[own], n[own], perfect.size), TOP).astype(np.uint16)
    often = own & (count[at] >= least)
    beside: dict[tuple[int, int], int] = defaultdict(int)  # lines whose hash another line has
    for k in np.flatnonzero(~own):
        beside[int(key[k]), int(mark[k])] += int(n[k])
    for k in np.flatnonzero(~own):
        often[k] = beside[int(key[k]), int(mark[k])] >= least
    return often


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents' own columns with the kept lines as text, and __n_lines, __n_dropped."""
    spark = docs.sparkSession
    common.tune(spark)
    if least > TOP:
        raise ValueError("counts saturate at 65535")
    columns = docs.columns
    groups = common.groups_for(spark, common.text_bytes(docs))
    spread = grouping.dealt(docs.withColumnsRenamed({"grp": "__grp"}) if "grp" in columns else docs, groups)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        key_hash, mark, n = _distinct(table)
        shard = (key_hash >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        return pa.table({"shard": shard.astype(np.int64), "grp": np.full(len(n), key[0].as_py(), np.int64), "key": key_hash.view(np.int64), "mark": mark.view(np.int32), "n": n.astype(np.int32)})

    def answer(asked: pa.Table) -> pa.Table:
        key, mark, n = (asked.column(x).to_numpy() for x in ("key", "mark", "n"))
        often = frequent(key.view(np.uint64), mark.view(np.uint32), n, least)
        return asked.select(["grp", "key", "mark"]).filter(pa.array(often))

    asked = spread.groupBy("grp").applyInArrow(ask, "shard long, grp long, key long, mark int, n int")
    answers = asked.repartition(groups, "shard").groupBy("shard").applyInArrow(answer, "grp long, key long, mark int")
    kept = [x for x in spread.columns if x != "grp"]
    schema = T.StructType([*spread.select(*kept).schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])

    def drop(table: pa.Table, marked: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in table.schema if f.name != "grp"} | {"__n_lines": pa.array([], pa.int64()), "__n_dropped": pa.array([], pa.int64())})
        hashes = np.unique(marked.column("key").to_numpy().view(np.uint64)) if marked.num_rows else np.zeros(0, np.uint64)
        pairs = set(zip(marked.column("key").to_numpy().view(np.uint64).tolist(), marked.column("mark").to_numpy().view(np.uint32).tolist(), strict=True)) if marked.num_rows else set()
        out = []
        for part in _parts(table):
            key, mark, has, doc, start, end, data = _line_keys(part.column("text"))
            gone = has & np.isin(key, hashes)
            at = np.flatnonzero(gone)
            gone[at] = [x in pairs for x in zip(key[at].tolist(), mark[at].tolist(), strict=True)]
            n = part.num_rows
            lines, dropped = np.bincount(doc, minlength=n), np.bincount(doc[gone], minlength=n)
            texts = part.column("text").to_pylist()
            raw = data.tobytes()
            bounds = np.searchsorted(doc, np.arange(n + 1))
            for d in np.flatnonzero(dropped):
                stay = np.flatnonzero(~gone[bounds[d] : bounds[d + 1]]) + bounds[d]
                texts[d] = b"\n".join([raw[start[i] : end[i]] for i in stay]).decode("utf-8")
            names = [x for x in part.schema.names if x != "grp"]
            made = [pa.array(texts, pa.string()) if x == "text" else part.column(x) for x in names]
            out.append(pa.RecordBatch.from_arrays([*made, pa.array(lines.astype(np.int64)), pa.array(dropped.astype(np.int64))], names=[*names, "__n_lines", "__n_dropped"]))
        return pa.Table.from_batches(out)

    done = spread.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(drop, schema)
    return done.withColumnsRenamed({"__grp": "grp"}).select(*columns, "__n_lines", "__n_dropped")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents
), keyed AS (
  SELECT doc_id, line, line_no, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN k.line END, chr(10) ORDER BY k.line_no), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that occur in ten documents or more; n_chars follows the text where the column is there."""
    got = dedup(docs)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)
