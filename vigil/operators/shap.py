"""What each column adds to a score of Spark's trees: path-dependent Shapley values.

A tree is a sum over its leaves: a leaf counts where all conditions on its path hold. If
only some columns of a row are known, a condition on another one holds with the share of
training rows that went that way. So a leaf's Shapley values need the conditions of its
own path alone, at most `depth` of them, and a polynomial in the number of known ones.
Leaves with equally many columns are worked out together, over a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_CELLS = 4 << 20  # rows times leaves worked out together


@dataclass
class Leaves:
    """Leaves with the same number of columns on their path: columns, bounds (low < x <= high) and shares, leaf by leaf, and values."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def _paths(node, path: dict[int, tuple[float, float, float]], value_of) -> Iterator[tuple[dict, float]]:
    """Each leaf below a node: its conditions by column, and its value."""
    if node.getClass().getSimpleName() != "InternalNode":
        yield path, value_of(node)
        return
    split, whole = node.split(), node.impurityStats().count()
    column, cut = split.featureIndex(), split.threshold()
    for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, share = path.get(column, (-inf, inf, 1.0))
        share *= child.impurityStats().count() / whole if whole else 0.5
        yield from _paths(child, path | {column: (low, min(high, cut), share) if below else (max(low, cut), high, share)}, value_of)


def leaves_of(model) -> tuple[dict[int, Leaves], float]:
    """The leaves of a boosted, forest or single tree model by their number of columns, and the score of an unknown row. The model is on the driver already; its trees are read once."""
    trees = getattr(model, "trees", None) or [model]
    weights = list(getattr(model, "treeWeights", None) or [1.0] * len(trees))
    boosted = "GBT" in type(model).__name__
    weights = weights if boosted else [w / sum(weights) for w in weights]

    def share_of_one(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if sum(stats) else 0.0

    found: dict[int, list[tuple]] = {}
    base = 0.0
    for tree, weight in zip(trees, weights, strict=True):
        for path, value in _paths(tree._java_obj.rootNode(), {}, (lambda n: n.prediction()) if boosted or "Regression" in type(tree).__name__ else share_of_one):
            base += weight * value * float(np.prod([s for _, _, s in path.values()]))
            found.setdefault(len(path), []).append((path, weight * value))
    found.pop(0, None)  # a tree that never splits is the same for all rows
    made = {}
    for d, own in found.items():
        cells = lambda k: np.array([[c[k] for c in p.values()] for p, _ in own])  # noqa: B023, E731
        made[d] = Leaves(np.array([list(p) for p, _ in own]), cells(0), cells(1), cells(2), np.array([v for _, v in own]))
    return made, base


def contributions(x: np.ndarray, leaves: dict[int, Leaves], columns: int) -> np.ndarray:
    """Shapley values of each row and column."""
    out = np.zeros((len(x), columns))
    for d, own in leaves.items():
        weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
        for a in range(0, len(own.value), step := max(1, BATCH_CELLS // max(1, len(x)))):
            column, z, value = own.column[a : a + step], own.share[a : a + step], own.value[a : a + step]
            seen = x[:, column]
            holds = ((seen > own.low[a : a + step]) & (seen <= own.high[a : a + step])).astype(float)
            for i in range(d):
                known = [np.ones(holds.shape[:2])]  # by how many of the other columns are known
                for j in range(d):
                    if j != i:
                        known = [(known[k] * z[:, j] if k < len(known) else 0) + (known[k - 1] * holds[:, :, j] if k else 0) for k in range(len(known) + 1)]
                each = (holds[:, :, i] - z[:, i]) * value * sum(w * k for w, k in zip(weight, known, strict=True))
                order = np.argsort(column[:, i], kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(column[order, i]) > 0])
                out[:, column[order, i][first]] += np.add.reduceat(each[:, order], first, axis=1)
    return out


def explained(rows: DataFrame, model, columns: list[str], keep: list[str]) -> DataFrame:
    """The kept columns, `base` and `shap`, an array in the order of the columns: base and its sum are the margin (boosted trees) or the share of class 1 (others). Missing and non-finite values count as -1, as in training. The leaves travel by broadcast; trees and depth bound them."""
    leaves, base = leaves_of(model)
    sent = rows.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"__{k}").to_numpy(zero_copy_only=False) for k in range(len(columns))]) if batch.num_rows else np.zeros((0, len(columns)))
            each = contributions(x, sent.value, len(columns))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, each.size + 1, len(columns), dtype=np.int32)), pa.array(each.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), listed], names=[*keep, "shap"])

    value = lambda c: F.coalesce(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")), F.lit(-1.0))
    given = rows.select(*keep, *(value(c).alias(f"__{k}") for k, c in enumerate(columns)))
    schema = T.StructType([*given.select(*keep).schema.fields, T.StructField("shap", T.ArrayType(T.DoubleType()))])
    return given.mapInArrow(run, schema).withColumn("base", F.lit(float(base)))


def mean_sizes(rows: DataFrame, model, columns: list[str]) -> DataFrame:
    """feature and the mean size of what it adds, over all rows."""
    each = explained(rows.select(*columns), model, columns, []).agg(*(F.avg(F.abs(F.col("shap")[k])).alias(f"__{k}") for k in range(len(columns))))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.coalesce(f"__{k}", F.lit(0.0)), 6).alias("mean_size")) for k, c in enumerate(columns)))
    return each.select(F.explode(pairs).alias("x")).select("x.*")

