"""Language identification with hyperdimensional profiles.

Every letter symbol has a random +1/-1 vector of DIMENSIONS entries. A trigram
binds the twice, once and not rotated vectors of its letters by multiplication;
a document bundles (sums) its trigrams; a language prototype is the sum over the
training documents of that language. The prediction is the language whose
prototype has the largest cosine with the document's vector.

Letters are lower-cased by code point; a-z have a symbol each, all other letters
share 37 by a hash of the code point. All characters that are no letters act as
one boundary symbol; trigrams have a letter in the middle.

Null text or text without any letter: `und`, score 0. No training rows: `und`.
Ties go to the language first in alphabetical order. Every row counts by itself,
repeated ones too. Null languages are not learned. Other columns are ignored. Very
long texts are handled a row at a time. Empty tables give no rows.
The model is one vector a language, summed by Spark, so it does not grow.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

DIMENSIONS = 512
SYMBOLS = 64
SEED = 7

_LETTERS: list[np.ndarray] = []


def _vectors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.int8) * 2 - 1


def _symbol(cp: int) -> int:
    c = chr(cp)
    if not unicodedata.category(c).startswith("L"):
        return 0
    low = c.lower()[:1]
    if "a" <= low <= "z":
        return ord(low) - 96
    return 27 + (ord(low) * 2654435761 >> 8) % 37


def _letters() -> np.ndarray:
    """Symbol of each code point of the basic plane, built once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.array([0 if 0xD800 <= cp < 0xE000 else _symbol(cp) for cp in range(0x10000)], np.uint8))
    return _LETTERS[0]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram ids with a letter in the middle, their range per document, and whether a document has a letter."""
    data, offsets = common.utf8(column)
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    symbol = _letters()[np.minimum(cp, 0xFFFF)].astype(np.int32)
    for far in np.flatnonzero(cp > 0xFFFF):
        symbol[far] = _symbol(int(cp[far]))
    count = len(symbol)
    around = np.zeros(count + 2, np.int32)
    around[1:-1] = symbol
    left, right = around[:-2].copy(), around[2:].copy()
    filled = np.flatnonzero(np.diff(starts) > 0)
    left[starts[filled]] = 0
    right[starts[filled + 1] - 1] = 0
    at = np.flatnonzero(symbol)
    bounds = np.searchsorted(at, starts)
    return (left[at] << 12) | (symbol[at] << 6) | right[at], bounds, np.diff(bounds) > 0


def bound(ids: np.ndarray) -> np.ndarray:
    """The trigrams' vectors: rotated letter vectors, multiplied."""
    v = _vectors()
    one, two = np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)
    return two[ids >> 12] * one[(ids >> 6) & 63] * v[ids & 63]


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in common.slices(batch):
            ids, bounds, _ = trigrams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            each = np.repeat(np.arange(len(langs)), np.diff(bounds))
            for lang in set(langs):
                got = np.bincount(ids[(langs == lang)[each]], minlength=SYMBOLS**3)
                total[lang] = total.get(lang, 0) + got
    for lang, count in total.items():
        seen = np.flatnonzero(count)
        vector = np.zeros(DIMENSIONS)
        for a in range(0, len(seen), 1 << 14):
            vector += count[seen[a : a + (1 << 14)]] @ bound(seen[a : a + (1 << 14)]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.astype(np.int64)])], names=["lang", "vector"])


def fit(docs: DataFrame, held_out: int = 3) -> dict[str, np.ndarray]:
    """Unit prototypes from all rows with a language outside the held-out fold."""
    common.tune(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.remainder("doc_id", held_out) != 1)).select("text", "lang")
    sums = rows.mapInArrow(_bundles, "lang string, vector array<long>").select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").cast("double").alias("v"))
    got = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("v")).collect()
    made = {r.lang: np.array([x.v for x in r.v]) for r in got}
    return {lang: v / max(np.linalg.norm(v), 1e-9) for lang, v in sorted(made.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 where negative) of each row."""
    spark = docs.sparkSession
    common.tune(spark)
    langs = list(prototypes)
    shared = spark.sparkContext.broadcast(np.array([prototypes[x] for x in langs], np.float32).reshape(len(langs), DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.T
        for batch in batches:
            for part in common.slices(batch):
                ids, bounds, has = trigrams(part.column("text"))
                vectors = np.zeros((len(has), DIMENSIONS), np.float32)
                seen = np.flatnonzero(np.bincount(ids, minlength=SYMBOLS**3)) if len(ids) else ids
                rank = np.zeros(SYMBOLS**3, np.int32)
                rank[seen] = np.arange(len(seen), dtype=np.int32)
                each = bound(seen).astype(np.float32)
                for k in np.flatnonzero(has):
                    own, n = np.unique(rank[ids[bounds[k] : bounds[k + 1]]], return_counts=True)
                    for a in range(0, len(own), 4096):
                        vectors[k] += n[a : a + 4096].astype(np.float32) @ each[own[a : a + 4096]]
                cosine = (vectors @ known) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                if langs:
                    best = cosine.argmax(1)
                    name = [langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                    score = np.where(has, np.clip(cosine[np.arange(len(has)), best], 0, 1), 0.0)
                else:
                    name, score = ["und"] * len(has), np.zeros(len(has))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(name, pa.string()), pa.array(score.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
