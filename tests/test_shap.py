"""Shapley values of Spark's trees against sums over all subsets of columns."""

from itertools import combinations
from math import factorial

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigil.operators import shap, training

COLUMNS = ["a", "b", "c"]


def expected(node, row, known, value_of):
    """What a tree says of a row of which some columns are known."""
    if node.getClass().getSimpleName() != "InternalNode":
        return value_of(node)
    column, left, right = node.split().featureIndex(), node.leftChild(), node.rightChild()
    if column in known:
        return expected(left if row[column] <= node.split().threshold() else right, row, known, value_of)
    whole = node.impurityStats().count()
    return sum(child.impurityStats().count() / whole * expected(child, row, known, value_of) for child in (left, right))


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_against_all_subsets(spark, kind):
    i = F.col("id")
    rows = spark.range(400).select("id", (i * 7 % 23).alias("a"), F.when(i % 9 != 0, i * 5 % 17).alias("b"), (i * 3 % 5).alias("c"))
    rows = rows.withColumn("y", (((F.col("a") > 11) != (F.coalesce("b", F.lit(0)) > 8)) | (F.col("c") == 2)).cast("int"))
    model = training.learners(4, 3)[kind].fit(training.assembled(rows, COLUMNS).select("features", "y"))
    raw = "rawPrediction" if kind == "boosted" else "probability"
    margin = {r.id: r.m for r in model.transform(training.assembled(rows, COLUMNS)).select("id", vector_to_array(raw)[1].alias("m")).collect()}
    got = shap.explained(rows, model, COLUMNS, ["id"]).collect()
    assert len(got) == 400
    for r in got:
        assert r.base + sum(r.shap) == pytest.approx(margin[r.id], abs=1e-9)
    stats = lambda n: list(n.impurityStats().stats())
    value_of = (lambda n: n.prediction()) if kind == "boosted" else lambda n: stats(n)[1] / sum(stats(n))
    weights = model.treeWeights if kind == "boosted" else [1 / len(model.trees)] * len(model.trees)
    roots = [t._java_obj.rootNode() for t in model.trees]
    given = {r.id: [float(r.a), float(r.b if r.b is not None else -1), float(r.c)] for r in rows.collect()}
    for r in sorted(got, key=lambda r: r.id)[:6]:
        of = {s: sum(w * expected(t, given[r.id], s, value_of) for w, t in zip(weights, roots, strict=True)) for n in range(4) for s in combinations(range(3), n)}
        for k in range(3):
            rest = [s for s in of if k not in s]
            want = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (of[tuple(sorted((*s, k)))] - of[s]) for s in rest)
            assert r.shap[k] == pytest.approx(want, abs=1e-9)
    assert {x.feature: x.mean_size for x in shap.mean_sizes(rows, model, COLUMNS).collect()} == {c: pytest.approx(sum(abs(r.shap[k]) for r in got) / 400, abs=1e-5) for k, c in enumerate(COLUMNS)}
    assert shap.explained(rows.limit(0), model, COLUMNS, ["id"]).count() == 0
