"""Tables of names and words of any length against text: near names by a deletion index, contained words by a filtered join of windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.sources import scratch

FILTER_BITS = 1 << 28  # of the bit array before the join, at most: 32 MB
CORE = 32  # places of a window that count for its bit
PIECE = 1 << 20  # window begins worked out together


def _less_one(text: Column) -> Column:
    """The text without each of its letters in turn."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<string>"))


def shortened(text: Column, most: int) -> Column:
    """Hashes of the text and of all it becomes by deleting up to `most` letters, each once."""
    level = every = F.array(text)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, _less_one)))
        every = F.concat(every, level)
    return F.array_distinct(F.transform(every, lambda x: F.xxhash64(x)))


def near(texts: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """text, name, distance of every two at an edit distance of `most` or less. texts: column text; names: column name.

    Two texts that are near have a shortened form in common, `most` letters shorter at
    the most, so equal texts are shortened once, forms meet by hash in a shuffle join,
    and the distance of what met is worked out. Texts longer than the longest name and
    `most` letters are near none. Nulls are near nothing. Names are short: their forms
    grow with the length to the power of `most`.
    """
    known = names.select("name").where("name is not null").distinct()
    longest = known.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0]
    asked = texts.select("text").where(F.length("text") <= longest + most).distinct()
    forms = lambda df, c: df.select(c, F.explode(shortened(F.col(c), most)).alias("form"))
    met = forms(asked, "text").join(forms(known, "name"), "form").where(F.abs(F.length("text") - F.length("name")) <= most).select("text", "name").distinct()
    return met.withColumn("distance", F.levenshtein("text", "name", most)).where("distance >= 0")


def nearest(texts: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """Adds name and distance of the nearest name (the first in order among equals) to the rows of texts; nulls where none is near."""
    best = near(texts, names, most).groupBy("text").agg(F.min(F.struct("distance", "name")).alias("best"))
    return texts.join(best, "text", "left").select(*texts.columns, F.col("best.name").alias("name"), F.col("best.distance").alias("distance"))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(codes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length in rising order a number for every window of so many code points; of longer windows the first CORE places count."""
    sums, places, by = np.zeros(len(codes), np.uint64), 0, _multipliers(CORE)
    for length in lengths:
        if length > len(codes):
            return
        while places < min(length, CORE):
            sums[: len(codes) - places] += codes[places:] * by[places]
            places += 1
        x = sums[: len(codes) - length + 1] + np.uint64(length)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        yield length, x ^ (x >> np.uint64(29))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each word, as a window of its own length."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        first, out = np.cumsum(size) - size, np.zeros(len(words), np.uint64)
        for length, x in _windows(_codes("".join(words)), sorted(set(size.tolist()))):
            out[size == length] = x[first[size == length]]
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["x"])


def _bit_array(words: DataFrame, count: int) -> np.ndarray:
    """A bit for each word's number: the bitmaps of Spark's bitmap aggregate, side by side."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (64 * count).bit_length()))
    at = (F.col("x").bitwiseAND(size - 1) + 1).alias("at")  # bucket 1 holds positions from 1 on
    maps = words.mapInArrow(_numbered, "x long").select(at).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    held = np.zeros((size >> 15, 4096), np.uint8)
    for k, bits in maps.toLocalIterator():
        held[k - 1] = np.frombuffer(bits, np.uint8)
    return held.reshape(-1)


def _candidates(lengths: list[int], sent):
    """key, word and n, how often, of the windows of each text whose bit is set."""

    def of(text: str, held: np.ndarray) -> Counter:
        found: Counter = Counter()
        for a in range(0, len(text), PIECE):
            piece = text[a : a + PIECE + lengths[-1] - 1]
            for length, x in _windows(_codes(piece), lengths):
                at = x[:PIECE] & np.uint64(8 * len(held) - 1)
                begins = np.flatnonzero(held[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                found.update([piece[i : i + length] for i in begins.tolist()])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                found = of(text.as_py(), sent.value)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), pa.binary()), pa.array(list(found)), pa.array(found.values(), pa.int64())], names=["key", "word", "n"])

    return run


def contained(rows: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """Adds n_words, how many different words of the table (column word) the text contains as substrings, and n_hits, how often any of them begins in it.

    The table may have any number of words. Windows of a text as long as some word pass a
    bit array of the words, which lets all true ones through (and more others beyond some
    four million words); those that pass meet the words themselves in a join. Texts go by
    their SHA-256, and counts of equal texts are divided by their number. A null text
    contains none; null and empty words are left out. Work grows with the texts times the
    number of different word lengths.
    """
    known = scratch.checkpoint(words.select("word").where("word <> ''").distinct())
    count, lengths = known.agg(F.count("*"), F.sort_array(F.collect_set(F.length("word")))).first()
    if not count:
        return rows.withColumns({"n_words": F.lit(0).cast("long"), "n_hits": F.lit(0).cast("long")})
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.sha2(body.cast("binary"), 256))
    sent = rows.sparkSession.sparkContext.broadcast(_bit_array(known, count))
    passed = rows.select(key.alias("key"), body.alias("text")).mapInArrow(_candidates(lengths, sent), "key binary, word string, n long")
    found = passed.join(known, "word").groupBy("key").agg(F.count("*").alias("words"), F.sum("n").alias("hits"))
    copies = rows.groupBy(key.alias("key")).agg(F.count("*").alias("copies"))
    each = found.join(copies, "key").select(F.col("key").alias("__key"), *(F.expr(f"{n} div copies").alias(f"n_{n}") for n in ("words", "hits")))
    return rows.withColumn("__key", key).join(each, "__key", "left").select(*rows.columns, *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_words", "n_hits")))
