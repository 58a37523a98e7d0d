"""Scorers trained with Spark's own tree learners, and the checks that come before training."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import dataset, evaluation, prefix
from vigil.sources import scratch

FOLDS, SEED = 5, 42
SINGLE_LIMIT, SHALLOW_LIMIT = 0.85, 0.90
ROWS_A_TASK, LEAST_TASKS = 250_000, 8
UNITS = 2_000_000  # beyond so many rows, equal rows are drawn together


def fold(key: str, folds: int = FOLDS, seed: int = SEED) -> Column:
    """A fold by hash of the key: independent of class and order, equal on every run, no shuffle."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def stratified(rows: DataFrame, label: str, key: str, folds: int = FOLDS, seed: int = SEED, tasks: int | None = None) -> DataFrame:
    """Adds __fold, dealt out in turn within each class: class counts of folds differ by one at most. Keys are unique."""
    return prefix.class_rank(rows, label, key, seed, tasks).withColumn("__fold", (F.col("place") % folds).cast("int")).drop("place")


def parts(n: int) -> int:
    return max(LEAST_TASKS, -(-n // ROWS_A_TASK))


def dealt(rows: DataFrame, n: int, key: str, *columns: str) -> DataFrame:
    """The columns of the n rows, dealt out by key in parts of about ROWS_A_TASK rows and kept: learners go over their input many times, and each task holds its part."""
    return scratch.checkpoint(rows.select(key, *columns).repartition(parts(n), key))


def learners(trees: int = 200, depth: int = 6, step: float = 0.1) -> dict:
    """The two candidates."""
    shared = {"featuresCol": "features", "labelCol": "y", "seed": SEED}
    return {"boosted": GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, **shared), "forest": RandomForestClassifier(numTrees=min(trees, 100), maxDepth=depth, **shared)}


def evidence_learner(trees: int = 300, depth: int = 5, step: float = 0.05) -> GBTClassifier:
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, featuresCol="features", labelCol="y", seed=SEED)


def filled(rows: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """y and the columns as numbers; a missing or non-finite value counts as -1, a row without a label is left out."""
    value = lambda x: F.when(F.isnan(F.col(x).cast("double")), None).otherwise(F.col(x).cast("double"))
    return rows.where(F.col(label).isNotNull()).withColumns({x: F.coalesce(value(x), F.lit(-1.0)) for x in columns}).withColumn("y", F.col(label).cast("double"))


def assembled(rows: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """`filled`, and features."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled(rows, columns, label))


def scored(model, rows: DataFrame) -> DataFrame:
    """Adds score: the probability of class 1, four places."""
    out = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 4))
    return out.drop("rawPrediction", "probability", "prediction")


@dataclass
class Trained:
    name: str
    model: object
    metrics: DataFrame
    columns: list[str]

    def save(self, path: str) -> None:
        PipelineModel([VectorAssembler(inputCols=self.columns, outputCol="features"), self.model]).write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """A saved scorer; None where there is none, and then rules decide alone (`fused` with a null score)."""
    try:
        SparkSession.active().read.text(f"{path}/metadata").limit(0).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return PipelineModel.load(path)


def best_candidate(rows: DataFrame, columns: list[str], key: str, label: str = "y", candidates: dict | None = None) -> Trained:
    """Fits the candidates on four fifths and keeps the one with the higher F1 on the rest, at the learners' own cut of 0.5. metrics: one row a candidate.

    The driver reads one row of counts for each candidate.
    """
    table = stratified(assembled(rows, columns, label), "y", key)
    table = dealt(table, rows.count(), key, "features", "y", "__fold")
    train, held = table.where("__fold <> 0").select("features", "y"), table.where("__fold = 0").select("features", "y")
    fitted, each = {}, []
    for name, learner in (candidates or learners()).items():
        fitted[name] = learner.fit(train)
        each.append(evaluation.confusion(scored(fitted[name], held), 0.5).withColumn("model", F.lit(name)))
    metrics = each[0]
    for other in each[1:]:
        metrics = metrics.unionByName(other)
    best = min(((-r.f1, r.model) for r in metrics.collect()), default=(0, next(iter(fitted))))[1]
    return Trained(best, fitted[best], metrics, columns)


def units(cells: DataFrame, rows: int, most: int) -> DataFrame:
    """Adds __n, how many rows a unit stands for, and __unit: cells of equal rows (how many is in __count) cut as evenly as can be in units of at most 1 + (rows - 1) // most rows. Up to `most` rows each is a unit of its own."""
    n, cut = F.col("__count"), F.ceil(F.col("__count") / F.lit(1 + (rows - 1) // most)).cast("long")
    each = cells.select("*", F.explode(F.sequence(F.lit(1).cast("long"), cut)).alias("__unit"))
    return each.withColumn("__n", (F.floor(n / cut) + F.when(F.col("__unit") <= n % cut, 1).otherwise(0)).cast("double")).drop("__count")


def weighing(learner, rows: int, joint: bool):
    """The learner over units of so many rows in all; where a unit stands for several, the least rows of a node are counted in rows all the same."""
    out = learner.copy().setWeightCol("__n")
    if joint:
        share = max(out.getMinWeightFractionPerNode(), (out.getMinInstancesPerNode() - 0.5) / rows)
        out = out.copy({out.minInstancesPerNode: 1, out.minWeightFractionPerNode: share})
    return out


def out_of_fold(rows: DataFrame, columns: list[str], key: str, label: str, learner, folds: int = FOLDS) -> DataFrame:
    """key, y, score: every row is scored by a model that did not see it.

    Equal rows of a fold (a cell) are counted once: learners go over them many times. Beyond
    UNITS rows they see units of equal rows with their number as weight, which subsampling
    draws as one; each cell is scored once, and rows get the score of their cell.
    """
    n = rows.count()
    numbers = filled(rows, columns, label).select(*dict.fromkeys([key, "y", *columns]))
    table = scratch.checkpoint(stratified(numbers, "y", key, folds, tasks=parts(n)))
    cell = ["__fold", "y", *columns]
    cells = scratch.checkpoint(table.groupBy(*cell).agg(F.count("*").alias("__count")))
    sizes = {r[0]: (r[1], r[2]) for r in cells.groupBy("__fold").agg(F.count("*"), F.sum("__count")).collect()}
    n_cells, n = (sum(x[j] for x in sizes.values()) for j in (0, 1))
    shown = units(cells, n, UNITS)
    # ordered, so that the draws of a learner are the same on every run
    shown = shown.repartition(parts(min(n, UNITS + n_cells)), *cell, "__unit").sortWithinPartitions(*cell, "__unit")
    shown = scratch.checkpoint(VectorAssembler(inputCols=columns, outputCol="features").transform(shown).select("__fold", "y", "features", "__n"))
    asked = VectorAssembler(inputCols=columns, outputCol="features").transform(cells)

    def fitted(k: int):
        weighed = weighing(learner, sum(x[1] for j, x in sizes.items() if j != k), n > UNITS)
        return weighed.fit(shown.where(F.col("__fold") != k).select("features", "y", "__n"))

    # folds of few units at once, as the jobs of their learners are short
    with ThreadPool(folds if n_cells <= UNITS else 1) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fitted), range(folds))
    each = [scored(model, asked.where(F.col("__fold") == k)).select(*cell, "score") for k, model in enumerate(models)]
    out = reduce(DataFrame.unionByName, each)
    out = F.broadcast(out) if n_cells <= ROWS_A_TASK else out
    return table.join(out, cell).select(key, "y", "score")


def importances(trained: Trained, most: int = 15) -> DataFrame:
    """feature, importance, of the most telling columns; ties by name."""
    listed = sorted(((float(v), n) for n, v in zip(trained.columns, trained.model.featureImportances.toArray(), strict=True)), key=lambda x: (-x[0], x[1]))[:most]
    return SparkSession.active().createDataFrame([(n, round(v, 6)) for v, n in listed], "feature string, importance double")


def shallow_accuracy(rows: DataFrame, columns: list[str], key: str, label: str = "y", folds: int = FOLDS) -> DataFrame:
    """One row: accuracy of a tree of depth 2 over held-out folds, and whether that is too good to be true."""
    tree = DecisionTreeClassifier(maxDepth=2, featuresCol="features", labelCol="y", seed=SEED)
    every = out_of_fold(rows, columns, key, label, tree, folds)
    right = F.when((F.col("score") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    return every.agg(F.round(F.avg(right), 4).alias("accuracy")).withColumn("flagged", F.col("accuracy") >= SHALLOW_LIMIT)


def leakage_verdict(rows: DataFrame, columns: list[str], url: str, key: str, label: str = "y") -> DataFrame:
    """One row: what each check found, and whether any found something. Each check is one row before they meet."""
    single = dataset.held_out_cuts(rows, columns, label, fold(key), FOLDS).agg(F.count_if(F.col("accuracy") >= SINGLE_LIMIT).alias("strong_columns"))
    found = dataset.separators(rows, columns, label).agg(F.count("*").alias("separators"))
    for other in (single, dataset.duplicates(rows, url, label), shallow_accuracy(rows, columns, key, label)):
        found = found.unionByName(other, allowMissingColumns=True)
    one = found.select("separators", "strong_columns", "duplicates", "conflicts", "accuracy", "flagged").agg(*(F.max(x).alias(n) for x, n in (("separators", "separators"), ("strong_columns", "strong_columns"), ("duplicates", "duplicates"), ("conflicts", "conflicts"), ("accuracy", "shallow_accuracy"), ("flagged", "shallow_flagged"))))
    return one.withColumn("leaks", (F.col("separators") > 0) | (F.col("strong_columns") > 0) | (F.col("duplicates") > 0) | (F.col("conflicts") > 0) | F.coalesce("shallow_flagged", F.lit(False)))
