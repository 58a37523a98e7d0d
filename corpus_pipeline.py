"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import common, decontaminate, lines, neardup, packing, toxicity

STAGES = [("toxicity", toxicity.stage), ("line_dedup", lines.stage), ("near_dedup", neardup.stage), ("decontamination", decontaminate.stage), ("packing", packing.stage)]

#: SQL cannot express the models and sketches of these stages; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage reads what its predecessor wrote: stages read their input more than once."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, common.written(docs) if k else docs, sf_dir)
    return docs
