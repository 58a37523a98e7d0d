"""Scan events as a stream: label counts by tumbling window, with a watermark. An extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources import scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed_labels(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    label = F.when(F.col("event_type") == "error", "Malicious").when(F.col("event_type") == "signup", "Suspicious").otherwise("Safe")
    seen = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return seen.groupBy(F.window("at", width), label.alias("threat_label")).agg(F.count("*").alias("n"))


def stream_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there and returns its final state: one row a window and label, which is all that the memory sink holds on the driver."""
    events = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"labels_{uuid.uuid4().hex}"
    query = windowed_labels(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{scratch.shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "threat_label", "n")


ORACLE = {"stream_label_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'signup' THEN 'Suspicious' ELSE 'Safe' END AS threat_label, count(*) AS n FROM events GROUP BY ALL"}
QUERIES = {"stream_label_counts": stream_label_counts}
