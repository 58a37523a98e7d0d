"""Connected components by alternating star rounds; edges stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, of every node with an edge. edges: columns a and b.

    A large-star round links each larger neighbour to the smallest known node, a
    small-star round does so for the smaller ones; both keep the components. The
    loop ends when a pair of rounds changes nothing: then all edges are stars.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    ordered = common.checkpoint(ordered)
    seen = None
    while True:
        state = ordered.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return ordered.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(ordered.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = state
        both = ordered.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(ordered.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        ordered = common.checkpoint(small)
