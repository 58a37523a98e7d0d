"""Learners get their input in parts that do not grow with it."""

from pyspark.sql import functions as F

from vigil.operators import training


def test_parts_of_the_input_of_learners(spark, monkeypatch):
    monkeypatch.setattr(training, "ROWS_A_TASK", 100)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).alias("y")).coalesce(1)
    got = training.dealt(rows, 4000, "key", "y")
    sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 40 and max(sizes) < 200
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
