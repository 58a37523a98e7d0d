"""Quality by a sparse rule ensemble.

1. Text statistics of each document, in one Arrow pass.
2. A random forest of shallow trees on a hashed sample of labelled rows (about
   SAMPLE_ROWS, the documented bound); each path to a node is a conjunctive rule.
3. Logistic regression with an L1 penalty over the rules keeps a few of them.
4. The rules that stay are compiled to one Spark column expression, evaluated on
   all rows by Spark itself.

Null or empty text has statistics of 0, but for line_repeat_share (1: no line is
distinct), and is scored like any other row. Without labels of both classes the score
is the share of good labels (0 without labels). Repeated rows are scored each by
themselves (one of them is learned from), and a doc_id labelled both ways counts as good. Very long texts are
handled a row at a time; ties in score need no order. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY = 12, 3, 0.002
BROADCAST_LABELS = 1_000_000

STATISTICS = ["log_bytes", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "bar_share", "bang_share", "point_share", "line_words", "wide_share", "distinct_share", "repeat_share", "line_repeat_share", "title_share", "short_share"]

_CLASS = np.zeros((8, 256), bool)
_CLASS[0, 65:91] = True  # upper
_CLASS[1, 48:58] = True  # digit
_CLASS[2, [ord(c) for c in "#$%&*@^~<>{}[]\\_=+/"]] = True  # symbol
_CLASS[3, ord("|")] = True
_CLASS[4, ord("!")] = True
_CLASS[5, [ord(c) for c in ".,;:?"]] = True
_CLASS[6, 128:] = True  # bytes of wide characters
_CLASS[7, 10] = True


def _statistics(column: pa.Array) -> list[np.ndarray]:
    data, offsets = common.utf8(column)
    size = np.diff(offsets)
    over = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    upper, digit, symbol, bar, bang, point, wide, line = (over(c[data]) for c in _CLASS)
    start, end, first = common.runs(~common.SPACE[data], offsets)
    words = np.diff(first)
    hashes = common.byte_hashes(data, start, end)
    doc = np.repeat(np.arange(len(size)), words)
    per = lambda mask: np.bincount(doc[mask], minlength=len(size))
    order = np.lexsort((hashes, doc))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = per(order[new])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    l_start, l_end, l_first = common.runs(data != 10, offsets)
    lines = np.diff(l_first)
    l_hash = common.byte_hashes(data, l_start, l_end)
    l_doc = np.repeat(np.arange(len(size)), lines)
    l_order = np.lexsort((l_hash, l_doc))
    l_new = np.ones(len(l_hash), bool)
    l_new[1:] = (l_hash[l_order][1:] != l_hash[l_order][:-1]) | (l_doc[l_order][1:] != l_doc[l_order][:-1])
    l_distinct = np.bincount(l_doc[l_order[l_new]], minlength=len(size))
    n, w, k = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    title = per(_CLASS[0][data[start]])
    short = per((end - start) <= 3)
    return [np.log1p(size), np.log1p(words), (size - line) / w, upper / n, digit / n, symbol / w, bar / w, bang / w, point / w, words / k, wide / n, distinct / w, per(again) / w, 1 - l_distinct / k, title / w, short / w]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.asarray(x, float)) for x in _statistics(part.column("text")))], names=["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{x} double" for x in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(debug: str) -> list[Rule]:
    """Paths from the root to every other node, from a tree's printed form; a step is (statistic, at most, threshold)."""
    rules: list[Rule] = []
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for row in debug.splitlines():
        if m := re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", row):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth]
            path.append((depth, (int(m[3]), m[4] == "<=", float(m[5]))))
            rules.append(tuple(sorted(x for _, x in path)))
    return rules


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for k, at_most, threshold in rule:
        c = F.col(STATISTICS[k])
        out = out & ((c <= threshold) if at_most else (c > threshold))
    return out


class Model:
    """Weighted rules; `base` is the intercept. No rules: `rate` is every score."""

    def __init__(self, rules: list[tuple[Rule, float]], base: float, rate: float | None = None):
        self.rules, self.base, self.rate = rules, base, rate

    def column(self) -> Column:
        if self.rate is not None:
            return F.lit(float(self.rate))
        total = F.lit(float(self.base))
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 4) -> Model:
    spark = docs.sparkSession
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where(common.remainder("doc_id", held_out) != 2)
    n, good = labels.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not 0 < good < n:
        return Model([], 0.0, good / n if n else 0.0)
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, round(n / SAMPLE_ROWS)))) == 0)
    side = F.broadcast(some) if n <= BROADCAST_LABELS else some
    sample = statistics(docs.select("doc_id", "text").join(side.select("doc_id"), "doc_id", "left_semi"))
    # one row a labelled doc_id, however many rows repeat it: the driver gets no more than the sample
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s")).join(side, "doc_id").select("doc_id", "quality", "s.*").toPandas().sort_values("doc_id").drop(columns="doc_id")
    if sample.quality.nunique() < 2:
        return Model([], 0.0, good / n)
    rows = spark.createDataFrame(sample).coalesce(1).withColumn("label", F.col("quality").cast("double"))
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=11, minInstancesPerNode=5).fit(rows)
    rules = sorted({r for tree in forest.trees for r in tree_rules(tree.toDebugString)})
    if not rules:
        return Model([], 0.0, good / n)
    fired = rows.select("label", *(rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired)
    sparse = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=40).fit(fired)
    weights = sparse.coefficients.toArray()
    return Model([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], float(sparse.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the statistics and score of each row."""
    return statistics(docs).withColumn("score", model.column())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
