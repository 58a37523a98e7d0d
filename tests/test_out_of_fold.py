"""Scores of rows by models that did not see them: equal rows are counted once, and count in full."""

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from vigil.operators import training as T


def _rows(spark, n):
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("k"), i).alias("key"), (i % 7).alias("a"), F.when(i % 10 != 3, i * i % 5).alias("b"), F.when(i % 500 != 1, F.when((i % 7 > 3) != (i * 31 % 11 == 0), 1).otherwise(0)).alias("y"))


def _plain(rows, tree):
    """The same by learners over all rows of the other folds."""
    table = T.stratified(T.assembled(rows, ["a", "b"]), "y", "key").cache()
    parts = [T.scored(tree.fit(table.where(F.col("__fold") != k)), table.where(F.col("__fold") == k)) for k in range(T.FOLDS)]
    return {r.key: (r.y, r.score) for p in parts for r in p.select("key", "y", "score").collect()}


@pytest.mark.parametrize(("units", "broadcast"), [(600, 200), (2_000_000, 250_000)])
def test_learners_see_equal_rows_together(spark, monkeypatch, units, broadcast):
    monkeypatch.setattr(T, "UNITS", units, raising=False)
    monkeypatch.setattr(T, "ROWS_A_TASK", broadcast)
    rows = _rows(spark, 8000)
    seen, fit = [], DecisionTreeClassifier.fit
    tree = DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=150, featuresCol="features", labelCol="y")
    want = _plain(rows, tree)

    def noted(learner, table, *more):
        seen.append(table.agg(F.count("*"), F.sum("__n") if "__n" in table.columns else F.count("*")).first())
        return fit(learner, table, *more)

    monkeypatch.setattr(DecisionTreeClassifier, "fit", noted)
    got = T.out_of_fold(rows, ["a", "b"], "key", "y", tree)
    assert got.columns == ["key", "y", "score"] and got.count() == 7984
    assert {r.key: (r.y, r.score) for r in got.collect()} == want
    labelled = rows.where("y IS NOT NULL")
    n_cells = 5 * labelled.select("a", "b", "y").distinct().count()
    assert len(seen) == T.FOLDS and sum(n for _, n in seen) == 4 * 7984
    assert all(k <= units + n_cells for k, _ in seen) and (units < 8000 or all(k == n for k, n in seen))


def test_units_stand_for_all_rows(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 10), ("c", 11), ("d", 978)], "c string, __count long")
    got = [(r.c, int(r["__n"])) for r in T.units(cells, 1000, 100).collect()]
    assert {c: sum(n for x, n in got if x == c) for c in "abcd"} == {"a": 1, "b": 10, "c": 11, "d": 978}
    assert max(n for _, n in got) == 10 and sum(x == "d" for x, _ in got) == 98 and min(n for x, n in got if x == "d") == 9
    assert sum(r["__n"] == 1 for r in T.units(cells, 1000, 1000).collect()) == 1000
