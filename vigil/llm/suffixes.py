"""Dedup of repeated byte strings by a logarithmic family of sampled suffix arrays.

Every window of WINDOW bytes samples one suffix of its text: the one that begins at the
smallest scrambled 8 bytes among the first PICKS places (the last of equal ones). What
is sampled depends on the window's bytes alone, so equal windows sample suffixes with
equal beginnings. Windows side by side that sample the same suffix are a run. An entry
of the array stands for a run: the name of its suffix's first CORE bytes (`core`, which
all windows with that suffix hold), and the name (x, y) of all bytes its windows span.
Names are three polynomial hashes modulo primes near 2**31, of 93 bits.

1. Batches of documents get arrays: entries sorted by their names, equal ones counted.
2. A new array is merge-scanned against every existing level: Spark's sort-merge join
   brings equal cores together. Entries with a core that occurs elsewhere are hits;
   equal (x, y) settle that all windows of both runs repeat.
3. Levels merge while the level before is less than twice as large, so sizes grow
   geometrically and there are about log2 of the number of batches.
4. Hits that are not settled are the edges of repeats. Their runs are divided into
   stretches of FINE windows at fixed distances from the suffix, and stretches that are
   still open into single windows, judged in the same way over all documents. One
   group leads for each settled run or stretch beside an open one and sends it once.
5. Each document removes the bytes under windows that repeat.

A suffix array sorted by letters would hold 8 bytes for each byte of text; this one has
about one entry in 128 bytes, sorted by names in place of letters. Nothing is lost by
the sampling: windows decide, and each window has its suffix.

A null text is empty, and texts shorter than a window stay whole. Each row is a document
of its own, whatever its doc_id: the same text twice repeats. Repeats within a document
count, overlapping ones too. Very long documents are taken in pieces that overlap by a
window. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm import common, grouping
from vigil.llm.substrings import Answers

WINDOW = 400
PICKS = 256
CORE = WINDOW - PICKS + 1
FINE = 16  # windows of a stretch
GRAM = 8
BATCHES = 4
LONG = 1 << 20  # window starts in a piece of a long document

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1812433253, 1566083941)
REACH = 4 << 20  # bytes hashed together, at most

RUN, STRETCH, SINGLE = range(3)
SETTLED, OPEN, LEADS = 1, 2, 3
NAME = ["core", "x", "y"]
ASKED = "grp long, core long, x long, y long, n long"


@cache
def powers(k: int) -> np.ndarray:
    """BASES[k] to each power below REACH, modulo PRIMES[k]."""
    out = np.ones(REACH, np.uint32)
    base, filled = BASES[k], 1
    while filled < REACH:
        more = min(filled, REACH - filled)
        out[filled : filled + more] = out[:more].astype(np.uint64) * np.uint64(base) % np.uint64(PRIMES[k])
        base, filled = base * base % PRIMES[k], filled + more
    return out


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row: block by block, from running minima in both directions."""
    n = len(key) - width + 1
    blocks = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Piece:
    """Texts side by side with the runs of their windows: first and last window start, sampled place and text of each run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.first = self.last = self.place = self.text = np.zeros(0, np.int64)
        self._sums: list[np.ndarray] = []
        n = len(data) - WINDOW + 1
        size = np.diff(offsets)
        some = np.flatnonzero(size >= WINDOW)
        if not len(some):
            return
        gram = np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)) * common.ODD
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        key = (gram[: n + PICKS - 1] & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n + PICKS - 1, dtype=np.uint64))
        place = (np.uint64(0xFFFFFFFF) - (sliding_least(key, PICKS) & np.uint64(0xFFFFFFFF))).astype(np.int64)
        step = np.zeros(n + 1, np.int8)
        step[offsets[some]] += 1
        step[offsets[some + 1] - WINDOW + 1] -= 1
        valid = np.cumsum(step[:-1], dtype=np.int8) > 0
        before = np.r_[False, valid[:-1] & (place[1:] == place[:-1])[: n - 1]] if n > 1 else np.zeros(1, bool)
        self.first = np.flatnonzero(valid & ~before)
        after = np.r_[before[1:] & valid[1:], False]
        self.last = np.flatnonzero(valid & ~after)
        self.place = place[self.first]
        self.text = np.searchsorted(offsets, self.first, "right") - 1

    def names(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names of the bytes of each stretch."""
        if not self._sums:
            byte = self.data.astype(np.uint64) + np.uint64(1)
            self._sums = [np.r_[np.uint64(0), np.cumsum(byte * powers(k)[: len(byte)])] for k in range(3)]
        h = [(s[end] - s[start]) % np.uint64(p) * powers(k)[REACH - 1 - start] % np.uint64(p) for k, (s, p) in enumerate(zip(self._sums, PRIMES, strict=True))]
        return common.mixed((h[0] << np.uint64(31) | h[1]) + (end - start).astype(np.uint64) * common.ODD), h[2]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.names(self.first, self.last + WINDOW)

    def stretches(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each stretch of the runs, and where its own core begins."""
        near, far = (self.place - self.last)[run], (self.place - self.first)[run]
        count = far // FINE - near // FINE + 1
        at = np.repeat(np.arange(len(run)), count)
        block = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + (near // FINE)[at]
        place = self.place[run][at]
        return place - np.minimum(far[at], FINE * block + FINE - 1), place - np.maximum(near[at], FINE * block), place - FINE * block


def singles(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    count = last - first + 1
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def pieces(column: pa.Array) -> Iterator[tuple[Piece, int, int]]:
    """The texts of a slice: those that are short together, long ones in overlapping pieces of LONG window starts. With the first text's number and where the piece begins in the slice's bytes.

    What a piece is depends on a document alone, so its runs are the same wherever the document is read.
    """
    data, offsets = common.utf8(column)
    long_ = np.flatnonzero(np.diff(offsets) > LONG)
    edge = 0
    for d in [*long_.tolist(), len(offsets) - 1]:
        if d > edge:
            yield Piece(data[offsets[edge] : offsets[d]], offsets[edge : d + 1] - offsets[edge]), edge, int(offsets[edge])
        if d < len(offsets) - 1:
            for at in range(int(offsets[d]), int(offsets[d + 1]) - WINDOW + 1, LONG):
                part = data[at : min(at + LONG + WINDOW - 1, int(offsets[d + 1]))]
                yield Piece(part, np.array([0, len(part)])), d, at
        edge = d + 1


def _question(grp: np.ndarray, core: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """A row for each distinct entry of a group, with how often it occurs."""
    order = np.lexsort((y, x, core, grp))
    rows = [a[order] for a in (grp, core, x, y)]
    at = np.flatnonzero(np.r_[True, np.any([a[1:] != a[:-1] for a in rows], axis=0)][: len(order)])
    return pa.RecordBatch.from_arrays([*(pa.array(a[at].view(np.int64)) for a in rows), pa.array(np.diff(np.r_[at, len(order)]).astype(np.int64))], names=["grp", *NAME, "n"])


def ask_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            grp = part.column("grp").to_numpy()
            for piece, text, _ in pieces(part.column("text")):
                yield _question(grp[text + piece.text], piece.names(piece.place, piece.place + CORE)[0], *piece.runs())


class Told:
    """What Spark answered to a group about its runs, stretches and windows."""

    def __init__(self, table: pa.Table):
        self.by = [Answers(table, k) for k in (RUN, STRETCH, SINGLE)]

    def of(self, kind: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The verdict on each name, 0 where there is none."""
        known = self.by[kind]
        at = known.find(x, y)
        return np.where(at >= 0, known.z[np.maximum(at, 0)], 0) if len(known.z) else np.zeros(len(x), np.int64)


def _pieces_of(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[Piece, int, int]]]]:
    for batch in table.combine_chunks().to_batches(max_chunksize=common.ARROW_ROWS):
        for part in common.slices(batch):
            yield part, pieces(part.column("text"))


def _undecided(piece: Piece, told: Told) -> np.ndarray:
    return np.flatnonzero(told.of(RUN, *piece.runs()) >= OPEN)


def _asked(key: tuple, found: list[pa.RecordBatch]) -> pa.Table:
    grp = key[0].as_py()
    parts = [np.concatenate([np.zeros(0, np.int64), *(f.column(c).to_numpy() for f in found)]) for c in NAME]
    times = np.concatenate([np.zeros(0, np.int64), *(f.column("n").to_numpy() for f in found)])
    order = np.lexsort((parts[2], parts[1], parts[0]))
    parts, times = [a[order] for a in parts], times[order]
    at = np.flatnonzero(np.r_[True, np.any([a[1:] != a[:-1] for a in parts], axis=0)][: len(order)])
    return pa.table([np.full(len(at), grp, np.int64), *(a[at] for a in parts), np.add.reduceat(times, at) if len(at) else times], names=["grp", *NAME, "n"])


def ask_stretches(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
    found = []
    if table.num_rows and answer.num_rows:
        told = Told(answer)
        for _, group in _pieces_of(table):
            for piece, _, _ in group:
                first, last, core = piece.stretches(_undecided(piece, told))
                found.append(_question(np.zeros(len(first), np.int64), piece.names(core, core + WINDOW - FINE + 1)[0], *piece.names(first, last + WINDOW)))
    return _asked(key, found)


def ask_windows(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
    found = []
    if table.num_rows and answer.num_rows:
        told = Told(answer)
        for _, group in _pieces_of(table):
            for piece, _, _ in group:
                first, last, _ = piece.stretches(_undecided(piece, told))
                some = told.of(STRETCH, *piece.names(first, last + WINDOW)) >= OPEN
                window = singles(first[some], last[some])
                x, y = piece.names(window, window + WINDOW)
                found.append(_question(np.zeros(len(window), np.int64), x, x, y))
    return _asked(key, found)


def repeated(piece: Piece, told: Told) -> tuple[np.ndarray, np.ndarray]:
    """First and last window starts of stretches that repeat."""
    verdict = told.of(RUN, *piece.runs())
    whole = (verdict == SETTLED) | (verdict == LEADS)
    first, last, _ = piece.stretches(np.flatnonzero(verdict == OPEN))
    verdict = told.of(STRETCH, *piece.names(first, last + WINDOW))
    settled = (verdict == SETTLED) | (verdict == LEADS)
    window = singles(first[verdict == OPEN], last[verdict == OPEN])
    window = window[told.of(SINGLE, *piece.names(window, window + WINDOW)) > 0]
    return np.r_[piece.first[whole], first[settled], window], np.r_[piece.last[whole], last[settled], window]


def _remove(table: pa.Table, answer: pa.Table) -> pa.Table:
    told = Told(answer)
    out = [pa.table({"doc_id": table.column("doc_id").slice(0, 0), "kept": pa.array([], pa.binary()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64())})]
    for part, group in _pieces_of(table) if table.num_rows else ():
        data, offsets = common.utf8(part.column("text"))
        step = np.zeros(len(data) + 1, np.int32)
        for piece, _, at in group if answer.num_rows else ():
            first, last = repeated(piece, told)
            np.add.at(step, at + first, 1)
            np.add.at(step, at + last + WINDOW, -1)
        gone = np.cumsum(step[:-1]) > 0
        before = np.r_[0, np.cumsum(gone)][offsets]
        kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((offsets - before).tobytes()), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
        spans = np.diff(common.runs(gone, offsets)[2])
        out.append(pa.table({"doc_id": part.column("doc_id"), "kept": kept, "n_bytes": np.diff(offsets), "n_removed": np.diff(before), "n_spans": spans.astype(np.int64)}))
    return pa.concat_tables(out)


def _entries(asked: DataFrame) -> DataFrame:
    """Equal entries in one row, with how often they occur and a group that has one."""
    return asked.groupBy(*NAME).agg(F.sum("n").alias("n"), F.min("grp").alias("lead"))


class Family:
    """Sampled suffix arrays as levels: written tables of entries (core, x, y, n, lead) in the order of their names, larger levels first."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.hits: list[DataFrame] = []

    def add(self, entries: DataFrame) -> None:
        """Scans a batch's array against itself and each level, then takes it in."""
        array = common.written(entries.orderBy(*NAME))
        rows = array.count()
        self.hits.append(self._within(array))
        self.hits += [self._across(array, level) for _, level in self.levels]
        while self.levels and self.levels[-1][0] < 2 * rows:
            _, level = self.levels.pop()
            array = common.written(array.unionByName(level).groupBy(*NAME).agg(F.sum("n").alias("n"), F.min("lead").alias("lead")).orderBy(*NAME))
            rows = array.count()
        self.levels.append((rows, array))

    @staticmethod
    def _within(array: DataFrame) -> DataFrame:
        cores = array.groupBy("core").agg(F.sum("n").alias("times")).where("times > 1")
        return common.written(array.join(cores.select("core"), "core"))

    @staticmethod
    def _across(array: DataFrame, level: DataFrame) -> DataFrame:
        both = array.withColumn("side", F.lit(1)).unionByName(level.withColumn("side", F.lit(2)))
        cores = array.select("core").distinct().join(level.select("core").distinct(), "core")
        return common.written(both.join(cores, "core").groupBy(*NAME).agg(F.sum("n").alias("n"), F.min("lead").alias("lead")))

    def found(self) -> DataFrame:
        """All hits; an entry that occurs again in any scan has n over 1."""
        every = self.hits[0]
        for more in self.hits[1:]:
            every = every.unionByName(more)
        return every.groupBy(*NAME).agg(F.max("n").alias("n"), F.min("lead").alias("lead"))


def _verdict(kind: int) -> list[Column]:
    """The columns of an answer, from what is counted for each entry and its core."""
    z = F.when(F.col("n") == 1, OPEN).when((F.col("alone") > 0) & (F.col("grp") == F.col("lead")), LEADS).otherwise(SETTLED)
    return [F.col("grp"), F.lit(kind).alias("kind"), F.col("x"), F.col("y"), z.cast("long").alias("z")]


def _told(asked: DataFrame, entries: DataFrame, kind: int) -> DataFrame:
    """The verdicts on entries whose core occurs elsewhere, for each group that has them."""
    cores = entries.groupBy("core").agg(F.sum("n").alias("times"), F.count_if(F.col("n") == 1).alias("alone")).where("times > 1")
    return asked.select("grp", *NAME).join(entries.join(cores, "core"), NAME).select(*_verdict(kind)).distinct()


def _told_once(asked: DataFrame, kind: int) -> DataFrame:
    """The same for questions that are not written: one exchange, by core, so the groups' texts are read once for them. A group asks each question once."""
    same, core = Window.partitionBy(*NAME), Window.partitionBy("core")
    counted = asked.select("grp", *NAME, F.sum("n").over(same).alias("n"), F.min("grp").over(same).alias("lead"))
    cores = counted.select("*", F.max("n").over(core).alias("most"), F.count("n").over(core).alias("rows"), F.count_if(F.col("n") == 1).over(core).alias("alone"))
    return cores.where("rows > 1 or most > 1").select(*_verdict(kind))


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans of every row."""
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select("doc_id", "text")
    groups = common.groups_for(spark, common.text_bytes(docs))
    asked = common.written(grouping.numbered(rows, groups).select("grp", "text").mapInArrow(ask_runs, ASKED))
    family = Family()
    for k in range(batches):
        family.add(_entries(asked.where(F.pmod("grp", F.lit(batches)) == k)))
    runs = common.written(_told(asked, common.written(family.found()), RUN))
    spread = grouping.dealt(rows, groups)
    undecided = lambda told: told.where(F.col("z") >= OPEN)
    # what is asked is used once: a second use with other columns would read and divide all texts again
    stretches = spread.groupBy("grp").cogroup(undecided(runs).groupBy("grp")).applyInArrow(ask_stretches, ASKED)
    told = runs.unionByName(_told_once(stretches, STRETCH))
    windows = spread.groupBy("grp").cogroup(undecided(told).groupBy("grp")).applyInArrow(ask_windows, ASKED)
    times = windows.select("grp", "x", "y", F.sum("n").over(Window.partitionBy("x", "y")).alias("times"))
    told = told.unionByName(times.where("times > 1").select("grp", F.lit(SINGLE).alias("kind"), "x", "y", F.lit(SETTLED).cast("long").alias("z")))
    return spread.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_remove, f"doc_id {dict(docs.dtypes)['doc_id']}, kept binary, n_bytes long, n_removed long, n_spans long")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
