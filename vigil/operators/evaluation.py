"""Evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import prefix


def confusion(scored: DataFrame, cut: float = 0.40) -> DataFrame:
    """score, y: counts, accuracy, precision, recall, F1; from the cut on a row counts as detected, by default from Suspicious (0.4)."""
    hit = F.col("score") >= cut
    bad = F.col("y") == 1
    c = scored.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    t, p, n, z = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(t + z, t + p + n + z).alias("accuracy"), ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"))


def confident(scored: DataFrame, thresholds=(0.5, 0.7, 0.8, 0.9, 0.95), least: int = 5) -> DataFrame:
    """Precision where the score is at least t; thresholds with fewer than `least` rows are left out."""
    every = scored.select("y", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))).alias("threshold"))
    return every.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("precision")).where(F.col("n") >= least)


def recall_threshold(scored: DataFrame, target: float) -> DataFrame:
    """The score whose recall is nearest to the target (the larger score on ties), by running counts over distinct scores."""
    run = prefix.running(scored.groupBy("score").agg(F.sum("y").alias("bad")), [], "score", ["bad"])
    run = run.select("score", "all_bad", (F.col("all_bad") - F.col("upto_bad") + F.col("bad")).alias("found"))
    return run.select("score", F.round(F.col("found") / F.col("all_bad"), 6).alias("recall")).orderBy(F.abs(F.col("recall") - target), F.desc("score")).limit(1)


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by rank sums over distinct scores; ties count half."""
    by = scored.groupBy("score").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    run = prefix.running(by, [], "score", ["good"]).withColumn("below", F.col("upto_good") - F.col("good"))
    return run.agg(F.round(F.sum(F.col("bad") * (F.col("below") + F.col("good") / 2)) / (F.sum("bad") * F.sum("good")), 6).alias("auc"))


def compared(verdicts: DataFrame) -> DataFrame:
    """y and the labels `fast` and `deep`: how often each was right, and what the deep scan gains. Malicious and Suspicious count as found."""
    right = lambda x: F.count_if(F.col(x).isin("Malicious", "Suspicious") == (F.col("y") == 1))
    both = verdicts.agg(F.count("*").alias("n"), right("fast").alias("right_fast"), right("deep").alias("right_deep"))
    share = lambda x: F.coalesce(F.round(F.col(x) / F.nullif(F.col("n"), F.lit(0)), 6), F.lit(0.0))
    return both.select("*", share("right_fast").alias("accuracy_fast"), share("right_deep").alias("accuracy_deep"), (F.col("right_deep") - F.col("right_fast")).alias("gained"))
