"""Toxicity by two class-conditional Kneser-Ney models over words and pairs of words.

Both classes share a backoff model of all labelled rows: a word after a history by
absolute discounting, a word by its continuation count, the number of different words
before it. A class keeps of its own count of an expression only what goes beyond that:
its discount is what the shared counts let expect of it in this class, some standard
deviations of that, and a constant more. The freed mass goes to the backoff. The
deviations grow with the labels as the largest of as many chance values does.

    x_c(h, w) = max(n_c(h, w) - E - deviations * sqrt(E * (1 - r)) - D, 0),  r = N_c(h) / N(h),  E = r * n(h, w)
    deviations = sqrt(2 * log(labelled documents of the smaller class))
    P_c(w)     = x_c(w) / N_c + L_c * S(w)                       L_c: what the discounts freed
    P_c(w | h) = x_c(h, w) / N_c(h) + L_c(h) * S(w | h) * P_c(w) / S(w)

So rare expressions, and frequent ones that both classes have alike, are the same to
both models but for the freed mass, and one that is frequent in one class alone tells.
Counts are of documents: an expression that one document repeats counts once. A
document's score is logistic in one number, the difference of the two length-normalised
log-likelihoods: the mean over its words of log P_toxic - log P_ordinary.

Words are runs of ASCII letters (lower-cased) and of all characters beyond ASCII.
Expressions are counted in a Spark table with a row for each (history, word) of the
labelled rows, so it grows with them. What of it tells is a table of terms that add up
to the log ratio: of a word, of a history (its freed mass), and of a pair beyond both.
Scoring looks up the FREQUENT most frequent terms in a broadcast of bounded size; where
there are more, a bit array of bounded size picks the terms of a document that may be
among the others, and these are joined by a shuffle. Both give the same result.

Null or empty text, or text without words, has evidence 0. Without labels of both
classes every document gets the share of toxic labels (0 without labels). The weights
come from rows that the model scoring them has not seen; where a class has few rows,
one at least is set apart and one is not. The only row of a class stands on both
sides. Repeated rows are scored each by themselves, rows of equal id and text alike.
Very long texts are handled a row at a time; ties in score need no order. Other columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import common, spelling

SHARED_DISCOUNT = 0.75
WORD_DISCOUNT, PAIR_DISCOUNT = 0.75, 1.0  # a pair that a class has once is left to the backoff
CALIBRATION_ROWS = 20_000  # training rows, about, that fit the two logistic weights; a quarter of them where they are few
BROADCAST_LABELS = 200_000  # up to so many labels are broadcast; more are joined by a shuffle
FREQUENT = 1 << 18  # terms of the model that are broadcast, at most: 16 bytes each

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
HELD_WORDS = 1 << 20  # words of text that a task counts before it sends them
START, SINGLE = np.uint64(2), 1  # the history of a first word, and the history of words by themselves
WORD_BITS, HISTORY_BITS = np.uint64((1 << 40) - 1), np.uint64((1 << 35) - 1)  # of a word's hash that are kept: rows of pairs are a word and a history
SALT_BITS = 3  # of a history, that part the pairs of one word, so that a word in every text is no task of its own
SALT = (1 << SALT_BITS) - 1


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of the word before it, and the first word of each document."""
    data, offsets = common.utf8(column)
    start, end, first = common.runs(LETTER[data], offsets)
    words = common.byte_hashes(common.LOWER[data], start, end) & WORD_BITS
    before = np.r_[START, words[:-1]][: len(words)] & HISTORY_BITS
    before[first[:-1][np.diff(first) > 0]] = START
    return words, before, first


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return common.mixed(common.mixed(before * common.ODD + common.BYTE_SEEDS[0]) + words)


def history_key(before: np.ndarray) -> np.ndarray:
    return common.mixed(before ^ common.BYTE_SEEDS[1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word and pair of about HELD_WORDS words of text with its documents by class: ordinary ones in the low half of a number, toxic ones in the high half."""
    held: list[tuple[np.ndarray, ...]] = []
    size = docs = 0
    for batch in batches:
        for part in common.slices(batch):
            words, before, first = words_of(part.column("text"))
            toxic, apart = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "apart"))
            n = np.diff(first)
            held.append((words, before, np.repeat(np.arange(part.num_rows) + docs, n), np.repeat(np.int64(1) << (32 * toxic), n), np.repeat(apart, n)))
            size, docs = size + len(words), docs + part.num_rows
            if size >= HELD_WORDS:
                yield from _summed(held)
                held, size = [], 0
    if size:
        yield from _summed(held)


def _summed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    words, before, doc, one, apart = (np.concatenate(x) for x in zip(*held, strict=True))
    for history in (np.full(len(words), SINGLE, np.uint64), before):
        # in the order of words: rows of one word lie together, and shuffle files are smaller
        order = np.lexsort((doc, history, words))
        new = lambda o: np.r_[True, (words[o][1:] != words[o][:-1]) | (history[o][1:] != history[o][:-1])]  # noqa: B023, E731
        once = order[new(order) | np.r_[True, doc[order][1:] != doc[order][:-1]]]
        at = np.flatnonzero(new(once))
        sums = [np.add.reduceat(np.where(apart[once] == side, one[once], 0), at) for side in (0, 1)]
        h, w = history[once][at].view(np.int64), words[once][at].view(np.int64)
        # the word with some bits of the history, and the history without them
        yield pa.RecordBatch.from_arrays([pa.array(w << SALT_BITS | h & SALT), pa.array(h >> SALT_BITS), *map(pa.array, sums)], names=["part", "rest", "main", "apart"])


EXPRESSION, WORD, HISTORY = range(3)


def deviations(smaller: int) -> float:
    return float(np.sqrt(2 * np.log(max(smaller, 1))))


def _low(c: str) -> Column:
    return F.col(c).bitwiseAND(0xFFFFFFFF)


def _high(c: str) -> Column:
    return F.shiftrightunsigned(c, 32)


def _counted(rows: DataFrame) -> DataFrame:
    """Three kinds of rows in one written table, from one exchange of (history, word): expressions with their documents by class (ordinary, toxic, and both apart), words with their continuation count, histories with totals and the number of different words after them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.select("text", "toxic", "apart").mapInArrow(_counts, "part long, rest long, main long, apart long")
    # slices are summed already; the exchange keeps their order
    each = each.repartition(parts, "part").groupBy("part", "rest").agg(F.sum("main").alias("main"), F.sum("apart").alias("apart"))
    each = each.select((F.shiftleft("rest", SALT_BITS) + F.col("part").bitwiseAND(SALT)).alias("h"), F.shiftright("part", SALT_BITS).alias("w"), "main", "apart")
    # every use reads all counts, so that the plans are alike and share the exchange
    numbers = {"n0": _low("main"), "n1": _high("main"), "a0": _low("apart"), "a1": _high("apart")}
    seen, single = F.col("main") + F.col("apart") > 0, F.col("h") == SINGLE
    twice = (numbers["n0"] + numbers["a0"] > 1) | (numbers["n1"] + numbers["a1"] > 1)
    none = F.lit(None).cast("long")
    kept = each.where(single | twice).select(F.lit(EXPRESSION).alias("kind"), "h", "w", *(v.alias(c) for c, v in numbers.items()), none.alias("different"))
    words = each.where(seen).groupBy("w").agg(F.count_if(seen & ~single).alias("different")).where("different > 0").select(F.lit(WORD).alias("kind"), none.alias("h"), "w", *(none.alias(c) for c in numbers), "different")
    histories = each.where(seen).groupBy("h").agg(*(F.sum(v).alias(c) for c, v in numbers.items()), F.count_if(seen).alias("different")).select(F.lit(HISTORY).alias("kind"), "h", none.alias("w"), *numbers, "different")
    return common.written(kept.unionByName(words).unionByName(histories))


class Terms:
    """What a model is made of: totals, and the terms of words, histories and pairs."""

    def __init__(self, counts: DataFrame, smaller: int):
        self.deviations = deviations(smaller)
        self.expressions = counts.where(F.col("kind") == EXPRESSION).drop("kind", "different")
        self.words = counts.where(F.col("kind") == WORD).select("w", F.col("different").alias("cont"))
        self.histories = counts.where(F.col("kind") == HISTORY).select("h", *(F.col(c).alias(f"h_{c}") for c in ("n0", "n1", "a0", "a1")), F.col("different").alias("kinds"))
        whole = self.histories.where(F.col("h") == SINGLE).first()
        self.total = {c: whole[f"h_{c}"] if whole else 0 for c in ("n0", "n1", "a0", "a1")}
        self.conts, self.types = self.words.agg(F.coalesce(F.sum("cont"), F.lit(0)), F.count("*")).first()

    def both_classes(self) -> bool:
        return all(self.total[f"n{k}"] + self.total[f"a{k}"] for k in (0, 1))

    def lacking(self) -> list[int]:
        """Classes without a row on one of the two sides."""
        return [k for k in (0, 1) if not self.total[f"n{k}"] or not self.total[f"a{k}"]]

    def _count(self, k: int, apart: bool, prefix: str = "") -> Column:
        """The class's count, of all rows or of those not set apart; the only row of a class stands on both sides."""
        own = F.col(f"{prefix}n{k}")
        return own if apart and self.total[f"n{k}"] else own + F.col(f"{prefix}a{k}")

    def share(self) -> Column:
        """S(w) by the continuation count."""
        cont = F.coalesce("cont", F.lit(0))
        return (F.greatest(cont - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * self.types / (self.types + 1)) / self.conts

    def beyond(self, own: Column, both: Column, own_total: Column, both_total: Column, constant: float) -> Column:
        """What a class's count is above its discount."""
        r = own_total / both_total
        expected = r * both
        return F.greatest(own - expected - self.deviations * F.sqrt(expected * (1 - r)) - constant, F.lit(0.0))

    def of(self, apart: bool) -> tuple[DataFrame, float]:
        """key, value and seen of every term, and what each word adds that no term is about."""
        n = [self._count(k, apart) for k in (0, 1)]
        total = [F.lit(self.total[f"n{k}"] if apart and self.total[f"n{k}"] else self.total[f"n{k}"] + self.total[f"a{k}"]) for k in (0, 1)]
        x = [self.beyond(n[k], n[0] + n[1], total[k], total[0] + total[1], WORD_DISCOUNT).alias(f"x{k}") for k in (0, 1)]
        single = self.expressions.where(F.col("h") == SINGLE).select("w", (n[0] + n[1]).alias("seen"), *x).where("x0 > 0 or x1 > 0")
        mass = single.agg(*(F.coalesce(F.sum(f"x{k}"), F.lit(0.0)) for k in (0, 1))).first()
        sums = [self.total[f"n{k}"] if apart and self.total[f"n{k}"] else self.total[f"n{k}"] + self.total[f"a{k}"] for k in (0, 1)]
        free = [1 - mass[k] / sums[k] for k in (0, 1)]
        constant = float(np.log(free[1] / free[0]))
        # P_c(w) / S(w)
        raised = lambda k: F.coalesce(F.col(f"x{k}"), F.lit(0.0)) / sums[k] / F.col("share") + free[k]
        word = single.join(self.words, "w").withColumn("share", self.share()).select("w", "seen", raised(0).alias("u0"), raised(1).alias("u1"))
        pairs = self.expressions.where(F.col("h") != SINGLE).join(self.histories, "h")
        t = [self._count(k, apart, "h_") for k in (0, 1)]
        x = [F.when(t[k] > 0, self.beyond(n[k], n[0] + n[1], t[k], t[0] + t[1], PAIR_DISCOUNT) / t[k]).otherwise(0.0).alias(f"x{k}") for k in (0, 1)]
        all_n, all_t = sum((F.col(c) for c in ("n1", "a0", "a1")), F.col("n0")), sum((F.col(c) for c in ("h_n1", "h_a0", "h_a1")), F.col("h_n0"))
        pairs = pairs.select("h", "w", "kinds", (n[0] + n[1]).alias("seen"), all_n.alias("n"), all_t.alias("t"), *x).where("x0 > 0 or x1 > 0")
        history = pairs.groupBy("h").agg(*((1 - F.sum(f"x{k}")).alias(f"free{k}") for k in (0, 1)), F.first("t").alias("seen"))
        after = (F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * F.col("share")) / F.col("t")
        joined = pairs.join(history.drop("seen"), "h").join(self.words, "w").withColumn("share", self.share()).join(word.drop("seen"), "w", "left")
        u = [F.coalesce(f"u{k}", F.lit(free[k])) for k in (0, 1)]
        p = [F.col(f"x{k}") + F.col(f"free{k}") * after * u[k] for k in (0, 1)]
        beyond = F.log(p[1] / p[0]) - F.log(u[1] / u[0]) - F.log(F.col("free1") / F.col("free0"))
        out = word.select(F.lit(0).alias("of"), F.lit(0).cast("long").alias("h"), "w", (F.log(F.col("u1") / F.col("u0")) - constant).alias("value"), "seen")
        out = out.unionByName(history.select(F.lit(1).alias("of"), "h", F.lit(0).cast("long").alias("w"), F.log(F.col("free1") / F.col("free0")).alias("value"), "seen"))
        return out.unionByName(joined.select(F.lit(2).alias("of"), "h", "w", beyond.alias("value"), "seen")), constant


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each term, as scoring looks it up."""
    for batch in batches:
        h, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("h", "w"))
        of = batch.column("of").to_numpy()
        key = np.where(of == 0, w, np.where(of == 1, history_key(h), pair_key(h, w)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c) for c in ("full", "apart", "seen"))], names=["key", "full", "apart", "seen"])


def _terms(counts: Terms) -> tuple[DataFrame, tuple[float, float]]:
    """key, full and apart (the value in the model of all rows and in that without the rows set apart), seen; and what each word adds in both."""
    (full, a), (apart, b) = counts.of(False), counts.of(True)
    value = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).cast("float").alias(c)
    both = full.withColumns({"full": F.col("value"), "apart": F.lit(0.0)}).unionByName(apart.withColumns({"full": F.lit(0.0), "apart": F.col("value")}))
    both = both.groupBy("of", "h", "w").agg(value("full"), value("apart"), F.max("seen").alias("seen"))
    return common.written(both.mapInArrow(_keyed, "key long, full float, apart float, seen long")), (a, b)


class Model:
    """Table of terms (None: nothing to learn from), its frequent part, a bit array of the rest, and the logistic weights."""

    def __init__(self, table: DataFrame | None, constant: tuple[float, float], weights: np.ndarray | None, rate: float):
        self.table, self.constant, self.weights, self.rate = table, constant, weights, rate
        self.frequent, self.rest, self.whole = None, None, True
        if table is not None:
            # terms by how often they are seen: there are few different numbers
            times = sorted(table.groupBy("seen").count().collect(), reverse=True)
            within = np.cumsum([r["count"] for r in times]) <= FREQUENT
            self.whole = bool(within.all())
            least = times[int(within.sum()) - 1].seen if within.any() else 2**62
            some = table.where(F.col("seen") >= least).select("key", "full", "apart").toPandas()
            key = some.key.to_numpy(np.int64).view(np.uint64)
            order = np.argsort(key)
            sc = table.sparkSession.sparkContext
            self.frequent = sc.broadcast((key[order], some.full.to_numpy(np.float32)[order], some.apart.to_numpy(np.float32)[order]))
            if not self.whole:
                others = table.where(F.col("seen") < least).select(F.col("key").alias("x"))
                self.rest = sc.broadcast(spelling.bit_array(others, others.count()))


def _row_key() -> list[Column]:
    """Two hashes of id and text: rows that agree in both have the same evidence."""
    one = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    return [F.xxhash64(*one).alias("__a"), F.xxhash64(F.lit(1), *reversed(one)).alias("__b")]


def _evidence(docs: DataFrame, model: Model, keep: list[str], name: str = "mean_evidence", apart: bool = False) -> DataFrame:
    """The kept columns and the mean evidence; apart: by the model without the rows set apart."""
    if model.table is None:
        return docs.select(*keep, F.lit(0.0).alias(name))
    frequent, rest, whole, which = model.frequent, model.rest, model.whole, 2 if apart else 1

    def read(kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, each = frequent.value[0], frequent.value[which]
            passes = None if whole else spelling.passes(*rest.value)
            for batch in batches:
                for part in common.slices(batch):
                    words, before, first = words_of(part.column("text"))
                    total, open_ = np.zeros(len(words)), []
                    for key in (words, history_key(before), pair_key(before, words)):
                        found = np.zeros(len(key), bool)
                        if len(known):
                            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                            found = known[at] == key
                            total += np.where(found, each[at], 0)
                        if not whole:
                            open_.append(np.where(~found & passes(key), key, 0))
                    sums = np.r_[0, np.cumsum(total)]
                    more = [] if whole else [_lists(np.stack(open_, 1).reshape(-1), 3 * first)]
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(np.diff(first).astype(np.int64)), *more], names=[*kept, "__sum", "__n", *(["__rest"] if more else [])])

        fields = [T.StructField("__sum", T.DoubleType()), T.StructField("__n", T.LongType()), *([] if whole else [T.StructField("__rest", T.ArrayType(T.LongType()))])]
        rows = docs.select(*dict.fromkeys([*keep, "text"]), *([] if whole else _row_key()))
        return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema.fields, *fields]))

    total = F.col("__sum")
    if whole:
        out = read(keep)
    else:
        more = read(["__a", "__b"]).where(F.size("__rest") > 0).groupBy("__a", "__b").agg(F.first("__rest").alias("__rest"))
        more = more.select("__a", "__b", F.explode("__rest").alias("key")).join(model.table.select("key", F.col("apart" if apart else "full").cast("double").alias("e")), "key").groupBy("__a", "__b").agg(F.sum("e").alias("__more"))
        out = read([*keep, "__a", "__b"]).join(more, ["__a", "__b"], "left")
        total = total + F.coalesce("__more", F.lit(0.0))
    mean = F.when(F.col("__n") > 0, total / F.col("__n") + model.constant[which - 1]).otherwise(0.0)
    return out.select(*keep, mean.alias(name))


def _lists(keys: np.ndarray, first: np.ndarray) -> pa.Array:
    """The keys of each document that are not 0, as lists."""
    pick = keys != 0
    offsets = np.r_[0, np.cumsum(pick)][first].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[pick].view(np.int64)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge on standardised columns; weights for the raw ones, the constant first."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [1e-1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.r_[w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale]


def _shared_out(rows: DataFrame, label: int, share: int) -> DataFrame:
    """Sets rows of a class apart by rank. For a class that the hash left out of a part, so it has few rows with text."""
    own = rows.where((F.col("toxic") == label) & F.col("text").rlike("[A-Za-z\\x{80}-\\x{10FFFF}]")).select("doc_id").distinct()
    ids = [r[0] for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    return rows.withColumn("apart", F.when(F.col("toxic") == label, F.col("doc_id").isin(ids[: max(1, len(ids) // share)]).cast("int")).otherwise(F.col("apart")))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> Model:
    """Counts over all labelled rows outside the held-out fold; the two weights from a hashed part of them, scored by a model without it."""
    common.tune(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(common.remainder("doc_id", held_out) != 0)
    n, toxic = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = toxic / n if n else 0.0
    side = F.broadcast(labels) if n <= BROADCAST_LABELS else labels
    # rows set apart calibrate weights on documents that a model without them has not seen
    share = max(4, round(n / CALIBRATION_ROWS))
    rows = docs.select("doc_id", "text").join(side, "doc_id").where("text is not null").withColumn("apart", (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).cast("int"))
    counts = Terms(_counted(rows), min(toxic, n - toxic))
    if not counts.both_classes():
        return Model(None, (0.0, 0.0), None, rate)
    if lacking := counts.lacking():
        for k in lacking:
            rows = _shared_out(rows, k, share)
        counts = Terms(_counted(rows), min(toxic, n - toxic))
    model = Model(*_terms(counts), None, rate)
    some = _evidence(rows.where("apart = 1"), model, ["toxic"], apart=True).toPandas()
    model.weights = _logistic(some[["mean_evidence"]].to_numpy(), some.toxic.to_numpy())
    return model


def _scored(model: Model, name: str) -> Column:
    if model.weights is None:
        return F.lit(float(model.rate))
    a, b = (F.lit(float(x)) for x in model.weights)
    return 1 / (1 + F.exp(-(a + b * F.col(name))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, mean_evidence and score of each row."""
    common.tune(docs.sparkSession)
    return _evidence(docs, model, ["doc_id"]).withColumn("score", _scored(model, "mean_evidence"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents scored 0.5 or more; learns from the rows it is given and their labels."""
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = _evidence(docs, model, docs.columns, "__evidence")
    return out.where(_scored(model, "__evidence") < 0.5).drop("__evidence")
