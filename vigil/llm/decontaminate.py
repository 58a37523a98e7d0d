"""Benchmark decontamination by random-walk embedding, bit sampling and exact edit distance.

Words are lower-cased runs of letters and digits. A benchmark item leaks into a
document if some stretch of the document is within an edit distance of it (over
words) of at most EDIT_SHARE of the item's length, rounded down; items under five
words leak only word for word.

1. Windows as long as the item, at every word of a document that any item has. Each
   edit brings at most one foreign word, and e edits leave one of e + 1 stretches of
   the item as it was; windows with more foreign words than edits allowed, or without
   such a stretch of any item of their length, are left out. No leak is lost by that.
2. The CGK embedding turns edit distance into Hamming distance: a walk writes the word
   under its pointer and moves on if a random bit of (step, word) says so. After an
   edit the walks over item and window meet again soon and agree from there.
3. Each of several independent walks is sampled at SAMPLES random steps within the
   item's length; the words there are the window's key in that walk's table. Walks are
   added until simulated leaks at the full number of edits are found with a chance of
   TARGET_RECALL at every item length of the block; equal stretches share all keys.
4. Windows and items that share a key are compared: a count of common words drops most
   chance hits, an exact edit distance decides, so nothing is reported wrongly.

Documents are read once and never shuffled. Items are taken in blocks of at most
ITEM_BLOCK items and BLOCK_WORDS words (the broadcast's bound), a single longer item by
itself; each further block is a further pass.

Null or empty texts and items without words never match; a null item_id is left out.
Repeated items and rows are reported as often as they come, once a pair of ids in a
row. Ties in distance do not matter. Very long texts and items only take longer: work
is cut into chunks of bounded size. Other columns are ignored (leaks) or kept (clean);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

EDIT_SHARE = 0.2
TARGET_RECALL = 0.99
SAMPLES = 3
MOST_WALKS = 128
ITEM_BLOCK, BLOCK_WORDS = 2000, 200_000
CELLS = 1 << 22  # numbers that one chunk of work holds, about
BITS = 20
WIDEST = 4  # words of an undisturbed stretch that are looked up, at most

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = common.utf8(column)
    start, end, first = common.runs(WORD[data], offsets)
    return common.byte_hashes(common.LOWER[data], start, end), first


def edits_for(length):
    return np.floor(EDIT_SHARE * np.asarray(length) + 1e-9).astype(np.int64)


class Walks:
    """Random bits, and the steps at which each walk is sampled for a window of some length."""

    def __init__(self, count: int, longest: int):
        rng = np.random.default_rng(81)
        self.fraction = np.sort(rng.random((MOST_WALKS, SAMPLES)), axis=1)[:count]
        self.steps = 2 * longest
        self.odd = np.stack([np.random.default_rng([82, w]).integers(0, 2**63, self.steps).astype(np.uint64) * np.uint64(2) + np.uint64(1) for w in range(count)])

    def embed(self, padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word under the pointer and the pointer (from start) at each step of each walk; the last entry of padded stands for places beyond end."""
        symbol = np.zeros((self.steps, len(self.odd), len(start)), np.int32)
        pointer = np.zeros_like(symbol)
        at = np.zeros((len(self.odd), len(start)), np.int64)
        code = common.mixed(padded.astype(np.uint64) * common.ODD + common.BYTE_SEEDS[0])
        for j in range(self.steps):
            place = start + at
            place[place >= end] = len(padded) - 1
            symbol[j], pointer[j] = padded[place], at
            at += ((code[place] * self.odd[:, j : j + 1]) >> np.uint64(63)).astype(np.int64)
        return symbol, pointer

    def keys(self, symbol: np.ndarray, pointer: np.ndarray, pick: np.ndarray, length: int) -> np.ndarray:
        """The picked windows' key in each walk's table, for windows of this many words."""
        walk = np.arange(len(self.odd))[:, None]
        key = common.mixed(np.array([length], np.uint64) * common.ODD + walk.astype(np.uint64)) + np.zeros(len(pick), np.uint64)
        for k in range(SAMPLES):
            step = np.floor(self.fraction[:, k] * 2 * length).astype(np.int64)[:, None]
            word = np.where(pointer[step, walk, pick] < length, symbol[step, walk, pick], 0)
            key = common.mixed(key * common.ODD + word.astype(np.uint64))
        return key


_WALKS: dict[int, int] = {}


def edited(rng: np.random.Generator, words: list[int], edits: int, fresh: int) -> list[int]:
    """The words after so many random substitutions, deletions and insertions of new words."""
    words = list(words)
    for k in range(edits):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        words[at : at + 1] = [[fresh + k], [], [words[at], fresh + k]][kind]
    return words


def walks_for(length: int, draws: int = 300) -> int:
    """Walks after which simulated leaks of an item of so many words, edited as often as allowed, are found with a chance of TARGET_RECALL."""
    if length not in _WALKS:
        rng, edits = np.random.default_rng(length), int(edits_for(length))
        if not edits:
            return 1
        room = length + edits
        rows = []
        for k in range(draws):
            words = edited(rng, list(range(length)), edits, length)
            while words and words[0] >= length:
                words.pop(0)
            words = [*words, *range(room, 2 * room)][:room]
            # each draw has words of its own
            rows += [np.arange(length) + 2 * room * k, np.array(words) + 2 * room * k]
        padded = np.r_[np.concatenate(rows) + 1, 0].astype(np.int32)
        size = np.tile([length, room], draws)
        start = np.cumsum(size) - size
        found, count = np.zeros(draws, bool), 0
        made = Walks(MOST_WALKS, length)
        symbol, pointer = made.embed(padded, start, start + size)
        keys = made.keys(symbol, pointer, np.arange(2 * draws), length)
        while count < MOST_WALKS and found.mean() < TARGET_RECALL:
            found |= keys[count, ::2] == keys[count, 1::2]
            count += 1
        _WALKS[length] = count
    return _WALKS[length]


def _ladder(length: int) -> int:
    """Lengths whose walks are simulated: every one up to 12, then steps of a quarter."""
    at = 12
    while at < min(length, 400):
        at += at // 4
    return length if length <= 12 else at


class Index:
    """Tables of one block of items."""

    def __init__(self, ids: list, texts: list[str]):
        words, first = words_of(pa.array(texts, pa.string()))
        count = np.diff(first)
        keep = np.flatnonzero(count)
        self.ids = [ids[k] for k in keep]
        self.vocabulary = np.unique(words)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.vocabulary >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.items = [self.numbers(words[first[k] : first[k + 1]]) for k in keep]
        self.length = count[keep]
        self.edits = edits_for(self.length)
        self.lengths = np.unique(self.length).tolist()
        if not self.items:
            return
        self.walks = Walks(max(walks_for(_ladder(n)) for n in self.lengths), max(self.lengths))
        padded = np.r_[np.concatenate(self.items), 0].astype(np.int32)
        begin = np.cumsum(self.length) - self.length
        # words of a stretch that stands undisturbed, by length, and what such stretches there are
        self.width = {n: min(WIDEST, n // (int(edits_for(n)) + 1)) for n in self.lengths}
        self.stretches = {}
        for width in set(self.width.values()):
            own = [begin[k] + np.arange(n - width + 1) for k, n in enumerate(self.length.tolist()) if self.width[n] == width]
            self.stretches[width] = np.unique(common.chained(padded.astype(np.uint64), np.concatenate(own), width))
        keys, owner = [], []
        for part, symbol, pointer in self._embedded(padded, begin, begin + self.length):
            for n in self.lengths:
                pick = np.flatnonzero(self.length[part] == n)
                if len(pick):
                    made = self.walks.keys(symbol, pointer, pick, n)
                    keys.append(made.reshape(-1))
                    owner.append(np.tile(part[pick], len(made)))
        key, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(key >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def _embedded(self, padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = max(16, CELLS // (self.walks.steps * len(self.walks.odd)))
        for a in range(0, len(start), size):
            part = np.arange(a, min(a + size, len(start)))
            yield part, *self.walks.embed(padded, start[part], end[part])

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Number of each word in the items' vocabulary; 0 for other words."""
        out = np.zeros(len(words), np.int32)
        maybe = np.flatnonzero(self.seen[(words >> np.uint64(64 - BITS)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == words[maybe], at + 1, 0)
        return out

    def _windows(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts of windows that may leak, their documents' ends, and for each length which of them have few enough foreign words."""
        start = np.flatnonzero(numbers)
        end = first[np.searchsorted(first, start, "right")]
        foreign = np.r_[0, np.cumsum(numbers == 0)]
        whole = {}
        for width, known in self.stretches.items():
            at = start[start + width <= end]
            at = at[foreign[at + width] == foreign[at]]
            key = common.chained(numbers.astype(np.uint64), at, width)
            stands = np.zeros(len(numbers) + 1, np.int64)
            stands[at[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key] + 1] = 1
            whole[width] = np.cumsum(stands)
        fits = np.zeros((len(self.lengths), len(start)), bool)
        for k, n in enumerate(self.lengths):
            edits, width = int(edits_for(n)), self.width[n]
            stop, last = np.minimum(start + n, end), np.minimum(start + n + edits, end) - width + 1
            fits[k] = (foreign[stop] - foreign[start] + (start + n - stop) <= edits) & (whole[width][np.maximum(last, start)] > whole[width][start])
        some = fits.any(0)
        return start[some], end[some], [np.flatnonzero(x) for x in fits[:, some]]

    def leaks(self, column: pa.Array) -> list[dict[int, int]]:
        """For each document: item (by position) and its smallest edit distance, where it leaks."""
        parts = [words_of(x.column("text")) for x in common.slices(pa.RecordBatch.from_arrays([column], names=["text"]))]
        found: list[dict[int, int]] = [{} for _ in range(len(column))]
        if not self.items or not parts:
            return found
        numbers = np.concatenate([self.numbers(words) for words, _ in parts])
        first = np.cumsum(np.concatenate([[0], *(np.diff(f) for _, f in parts)]))
        padded = np.r_[numbers, 0].astype(np.int32)
        start, end, fitting = self._windows(numbers, first)
        codes = [np.zeros(0, np.int64)]
        for part, symbol, pointer in self._embedded(padded, start, end):
            for n, own in zip(self.lengths, fitting, strict=True):
                pick = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")] - part[0]
                if not len(pick):
                    continue
                key = self.walks.keys(symbol, pointer, pick, n)
                walk, hit = np.nonzero(self.bitmap[(key >> np.uint64(64 - BITS)).astype(np.int64)])
                key = key[walk, hit]
                lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                times = hi - lo
                at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
                codes.append(np.unique(self.owner[at].astype(np.int64) * len(padded) + np.repeat(start[part[0] + pick[hit]], times)))
        code = np.unique(np.concatenate(codes))
        item_of, begin = code // len(padded), code % len(padded)
        mark = np.zeros(len(self.vocabulary) + 1, bool)
        for item in np.unique(item_of):
            length, edits = int(self.length[item]), int(self.edits[item])
            own = begin[slice(*np.searchsorted(item_of, [item, item + 1]))]
            mark[self.items[item]] = True
            size = max(1, CELLS // (length + 2 * edits))
            for c in range(0, len(own), size):
                at = own[c : c + size]
                doc = np.searchsorted(first, at, "right") - 1
                place = at[:, None] - edits + np.arange(length + 2 * edits)
                inside = (place >= first[doc][:, None]) & (place < first[doc + 1][:, None])
                window = np.where(inside, padded[np.clip(place, 0, len(numbers))], 0)
                likely = mark[window].sum(1) >= length - edits
                best = _distance(self.items[item], np.where(inside, window, -1)[likely])
                for k, e in zip(doc[likely][best <= edits].tolist(), best[best <= edits].tolist(), strict=True):
                    found[k][int(item)] = min(e, found[k].get(int(item), e))
            mark[self.items[item]] = False
        return found


def _distance(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Smallest edit distance between the item and any stretch of each window (-1: outside the document)."""
    n, width = windows.shape
    step = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    for k, symbol in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = k
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != symbol), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row.min(1) if n else np.zeros(0, np.int64)


def _blocks(items: DataFrame) -> Iterator[Index]:
    """The items, in blocks of bounded size, in the order of their ids."""
    block: list = []
    size = 0
    for row in items.where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        more = len(row.text) // 2 + 1  # words, at most
        if block and (len(block) == ITEM_BLOCK or size + more > BLOCK_WORDS):
            yield Index([r.item_id for r in block], [r.text for r in block])
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield Index([r.item_id for r in block], [r.text for r in block])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, edits: one row for each item that leaks into a document."""
    spark = docs.sparkSession
    common.tune(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, item_words long, edits long"
    out = spark.createDataFrame([], schema)
    item_type = pa.int64() if dict(items.dtypes)["item_id"] == "bigint" else None
    for index in _blocks(items.select("item_id", "text")):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = index.leaks(batch.column("text"))
                rows = [(k, i, e) for k, own in enumerate(found) for i, e in sorted(own.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows])), pa.array([index.ids[r[1]] for r in rows], item_type), pa.array([int(index.length[r[1]]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "item_id", "item_words", "edits"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents into which no item leaks, as they are."""
    common.tune(docs.sparkSession)
    for index in _blocks(items.select("item_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in shared.value.leaks(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those into which a benchmark item leaks."""
    return clean(docs, common.table(spark, sf_dir, "benchmark"))
