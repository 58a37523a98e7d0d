"""Readers and writers of the pipeline's files, with schemas of their own: nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPLOAD_LIMIT = 10 * 1024 * 1024


def ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rank int, domain string").csv(path)


def labelled_urls(spark: SparkSession, path: str, url: str = "URL", label: str = "label") -> DataFrame:
    """Two columns of a headed CSV; Spark prunes the others."""
    return spark.read.option("header", True).csv(path).select(F.col(url).alias("url"), F.col(label).cast("int").alias("label"))


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("domain")).where("domain <> ''")


def optional_lines(spark: SparkSession, path: str) -> DataFrame:
    """A feed that may be missing: then no rows."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    return optional_lines(spark, path).select(F.lower(F.trim("value")).alias("registered")).where("registered <> ''").distinct()


def uploads(spark: SparkSession, path: str, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Files with the reason that rejects them; contents over the limit are not carried on. Spark's file sources leave out files without bytes, so `empty` shows for rows from other tables only."""
    rows = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too large")
    return rows.select("path", "length", reason.alias("reject_reason"), F.when(reason.isNull(), F.col("content")).alias("content"))


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What `write_features` wrote: the columns as doubles, is_phishing and url."""
    return spark.read.schema(", ".join(f"{c} double" for c in columns) + ", is_phishing int, url string").parquet(path)


def append_history(scans: DataFrame, path: str) -> None:
    scans.write.mode("append").parquet(path)
