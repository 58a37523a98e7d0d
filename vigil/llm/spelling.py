"""Spelling variants by generating the full neighbourhood of every word.

1. Words are counted over whole texts: each task counts its texts and sends a row for
   each distinct word, and Spark adds up.
2. Each word of the vocabulary emits all its distinct deletions, replacements and
   insertions over the observed alphabet as 128-bit names. A name is a sum of
   scrambled numbers of (place, letter), so each candidate costs one addition. A letter
   is deleted only where it begins a run, inserted only where it does not extend the
   run before: so every candidate comes up once.
3. Candidates are hash-joined to the vocabulary by their names. What joins is at
   distance one by construction, and no distance is computed. Before the join they
   pass a bit array of the vocabulary's names (Spark's bitmap aggregates, FILTER_BITS
   at most): it lets every word of the vocabulary through, and the join decides.
4. A word's form is its most frequent near word, if that is `ratio` times as frequent.
   Roots follow the forms by pointer doubling: frequency grows by `ratio` at each step,
   so the rounds needed are known beforehand.

A run is `[A-Za-z\\u00C0-\\u00FF]+`, only A-Z lower-cased. Null text has no runs. A null
doc_id counts as an empty id in the noise of `noised`. Repeated rows count each. Ties in
frequency go to the smaller word in code-point order. Very long words emit their
candidates in pieces of bounded size. Other columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

LEAST_LETTERS, LEAST_SEEN, RATIO = 7, 2, 10
NOISE = 31
FILTER_BITS = 1 << 28  # of the bit array before the join, at most: 32 MB
HELD_WORDS = 200_000  # distinct words that a task counts before it sends them
PIECE = 1 << 20  # candidates made at once

LETTERS = bytes([*range(97, 123), *range(0xC0, 0x100)])
#: A byte of Latin-1 to its lower-case letter, or to a blank.
TO_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS else 32 for b in range(256))
CHUNK = 50_000  # bytes of words whose candidates are made together


def runs_of(text: str) -> list[bytes]:
    """The lower-cased runs, a byte for each letter."""
    return text.encode("latin-1", "replace").translate(TO_RUNS).split()


def noised(doc_id: str, run: bytes) -> bytes:
    """The run, or one letter less where 31 divides the crc32 of id and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    return run if h % NOISE else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                start, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
                own = []
                for w in runs_of(text.as_py() or ""):
                    if len(w) >= least:
                        h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % NOISE:
                            own.append(w)
                        elif len(w) > least:
                            own.append(w[: h % len(w)] + w[h % len(w) + 1 :])
                seen.update(own)
                if len(seen) > HELD_WORDS:
                    yield rows()
                    seen = Counter()
        if seen:
            yield rows()

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """word and n of every word that is long and frequent enough."""
    common.tune(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(_counts(least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_seen)


def _number(place: np.ndarray, letter: np.ndarray, seed: int) -> np.ndarray:
    return common.mixed(((place.astype(np.uint64) << np.uint64(8)) | letter) * common.ODD + common.BYTE_SEEDS[seed])


def _numbers(place: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The numbers of all letters at each place; from a table, as places come again with each word."""
    low, high = int(place.min()), int(place.max())
    if high - low > len(place):
        return _number(place[:, None], alphabet[None, :], 0)
    return _number(np.arange(low, high + 1)[:, None], alphabet[None, :], 0)[place - low]


def _of_length(length: np.ndarray, seed: int) -> np.ndarray:
    return common.mixed(length.astype(np.uint64) + common.BYTE_SEEDS[1 - seed])


class Words:
    """Words side by side: letters, place in the word, and sums of their numbers, also one place to the left and to the right."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.data)) - self.first[self.word]
        self.sums = [[np.r_[np.uint64(0), np.cumsum(_number(self.place + shift, self.data, seed))] for shift in (0, -1, 1)] for seed in (0, 1)]

    def names(self, seed: int) -> np.ndarray:
        own = self.sums[seed][0]
        return own[self.first + self.size] - own[self.first] + _of_length(self.size, seed)

    def _edited(self, seed: int, at: np.ndarray, word: np.ndarray, skip: int, shift: int) -> np.ndarray:
        """Name of a word without `skip` letters from place `at` on, the rest moved; a letter put there adds its number."""
        own, moved = self.sums[seed][0], self.sums[seed][shift]
        a, b = self.first[word] + at, self.first[word] + self.size[word]
        return own[a] - own[self.first[word]] + moved[b] - moved[a + skip] + _of_length(self.size[word] + (0, -1, 1)[shift], seed)

    def deletions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """word index and the two names of each distinct deletion."""
        begins = np.ones(len(self.data), bool)
        begins[1:] = (self.data[1:] != self.data[:-1]) | (self.place[1:] == 0)
        k = np.flatnonzero(begins)
        return self.word[k], *(self._edited(seed, self.place[k], self.word[k], 1, 1) for seed in (0, 1))

    def written_in(self, alphabet: np.ndarray, insert: bool, passes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for replacements or insertions that pass; in pieces of bounded size."""
        slots = self.size + 1 if insert else self.size
        word = np.repeat(np.arange(len(slots)), slots)
        place = np.arange(len(word)) - np.repeat(np.cumsum(slots) - slots, slots)
        for a in range(0, len(word), step := max(1, PIECE // len(alphabet))):
            w, p = word[a : a + step], place[a : a + step]
            skip, shift = (0, 2) if insert else (1, 0)
            one = self._edited(0, p, w, skip, shift)[:, None] + _numbers(p, alphabet)
            ok = passes(one)
            if insert:  # not after an equal letter
                before = np.where(p > 0, self.data[np.maximum(self.first[w] + p - 1, 0)], 0)
                ok &= alphabet[None, :] != before[:, None]
            else:
                ok &= alphabet[None, :] != self.data[self.first[w] + p][:, None]
            row, letter = np.nonzero(ok)
            yield w[row], one[row, letter], self._edited(1, p[row], w[row], skip, shift) + _number(p[row], alphabet[letter], 1)


def chunks(words: list[bytes]) -> Iterator[tuple[int, int]]:
    size = np.cumsum([len(w) for w in words]) // CHUNK
    cut = np.flatnonzero(np.diff(size)) + 1
    yield from zip(np.r_[0, cut].tolist(), np.r_[cut, len(words)].tolist(), strict=True)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the two names and the letters that occur, as bits."""
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        for a, b in chunks(words) if words else ():
            own = Words(words[a:b])
            bits = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            plain = own.data < 128
            np.bitwise_or.at(bits[0], own.word[plain], np.uint64(1) << (own.data[plain] - 97).astype(np.uint64))
            np.bitwise_or.at(bits[1], own.word[~plain], np.uint64(1) << (own.data[~plain] - 0xC0).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("word").slice(a, b - a), batch.column("n").slice(a, b - a), *(pa.array(x.view(np.int64)) for x in (own.names(0), own.names(1), *bits))], names=["word", "n", "x", "y", "plain", "accented"])


def alphabet_of(plain: int, accented: int) -> np.ndarray:
    bits = (plain % 2**64) & ((1 << 26) - 1) | (accented % 2**64) << 26
    return np.array([b for k, b in enumerate(LETTERS) if bits >> k & 1], np.uint8)


def bit_array(words: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bit array with two bits of each name: the bitmaps of Spark's bitmap aggregate, side by side."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    at = F.explode(F.array(F.col("x").bitwiseAND(size - 1) + 1, F.shiftrightunsigned("x", 32).bitwiseAND(size - 1) + 1))  # bucket 1 holds positions from 1 on
    maps = words.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    held = np.zeros((size >> 15, 4096), np.uint8)
    for k, bits in maps.toLocalIterator():
        held[k - 1] = np.frombuffer(bits, np.uint8)
    return held.reshape(-1), size


def passes(held: np.ndarray, size: int):
    def one(at: np.ndarray) -> np.ndarray:
        return held[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1

    def both(x: np.ndarray) -> np.ndarray:
        ok = one(x & np.uint64(size - 1)).astype(bool)
        ok[ok] = one((x[ok] >> np.uint64(32)) & np.uint64(size - 1)).astype(bool)
        return ok

    return both


def _candidates(alphabet: np.ndarray, filter_bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = passes(*filter_bits.value)
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            for a, b in chunks(words) if words else ():
                own = Words(words[a:b])
                word, x, y = own.deletions()
                ok = within(x)
                made = [(word[ok], x[ok], y[ok]), *own.written_in(alphabet, False, within), *own.written_in(alphabet, True, within)]
                word, x, y = (np.concatenate(k) for k in zip(*made, strict=True))
                rows = batch.slice(a, b - a).take(pa.array(word))
                yield pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["word", "n", "x", "y"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near and near_n for every two words of the table (word, n) at distance one, in both directions."""
    spark = words.sparkSession
    named = common.written(words.select("word", "n").mapInArrow(_named, "word string, n long, x long, y long, plain long, accented long"))
    count, plain, accented = named.agg(F.count("*"), F.coalesce(F.bit_or("plain"), F.lit(0)), F.coalesce(F.bit_or("accented"), F.lit(0))).first()
    alphabet = alphabet_of(plain, accented)
    bits = spark.sparkContext.broadcast(bit_array(named, count))
    # neighbourhoods are much larger than their words: as many tasks as a shuffle has
    spread = named.select("word", "n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    made = spread.mapInArrow(_candidates(alphabet, bits), "word string, n long, x long, y long")
    return made.join(named.select("x", "y", F.col("word").alias("near"), F.col("n").alias("near_n")), ["x", "y"]).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """word and root of words with a form (word, form), none of them more than so many steps away."""
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = common.written(roots.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return roots


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the table (word, n)."""
    common.tune(words.sparkSession)
    words = common.written(words.select("word", "n"))
    pick: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), pick.alias("best"))
    joined = words.join(best, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    judged = common.written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    most = judged.agg(F.max("form_n")).first()[0]
    steps = int(math.log(most, ratio)) + 1 if most else 0  # a step multiplies n by ratio at least
    roots = _roots(judged.where("form is not null"), steps)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(common.table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [195::UBIGINT, (ord(x) - 64)::UBIGINT] END))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM counted, crc_table
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND n >= 2
), less AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), steps AS (
  SELECT word, word AS root, form AS ahead FROM judged
  UNION ALL SELECT s.word, j.word, j.form FROM steps s JOIN judged j ON s.ahead = j.word
)
SELECT j.word, j.form, s.root, j.n, j.n_near, j.form_n FROM judged j JOIN steps s ON j.word = s.word AND s.ahead IS NULL
"""
