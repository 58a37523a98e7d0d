"""Scan history: statistics, recent scans, feedback, cache and limiter. Every read names its owner; rows without one belong to nobody."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.operators import prefix
from vigil.sources import scratch


def owned(history: DataFrame, owner) -> DataFrame:
    """Plain equality: a null owner never matches."""
    return history.where(F.col("user_id") == owner)


def label_counts(history: DataFrame) -> DataFrame:
    """One pass per owner: total, the three labels, and the two rollups."""
    count = lambda x: F.count_if(F.col("threat_label") == x)
    return history.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("total"), count("Safe").alias("safe"), count("Suspicious").alias("suspicious"), count("Malicious").alias("malicious")).withColumn("threats", F.col("malicious") + F.col("suspicious")).withColumn("dangerous", F.col("malicious"))


def recent(history: DataFrame, owner, n: int) -> DataFrame:
    """Latest scans of an owner; n is held between 1 and 100."""
    return owned(history, owner).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(n, 100)))


def recent_by_owner(history: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return history.where("user_id is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def search(history: DataFrame, kind: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """Filters that are given; text is found in any case."""
    out = history
    if kind:
        out = out.where(F.col("scan_type") == kind)
    if status:
        out = out.where(F.col("threat_label") == status)
    return out.where(F.contains(F.lower("input_value"), F.lit(text.lower()))) if text else out


def display_status(label: Column) -> Column:
    return F.when(label == "Safe", "safe").when(label == "Suspicious", "suspicious").when(label == "Malicious", "malicious").otherwise("error")


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5)


def snippet(text: Column, length: int = 200) -> Column:
    return F.left(text, F.lit(length))


def shown(history: DataFrame) -> DataFrame:
    """History rows as a client reads them: names of its own, no lists that are null, and whether the scan was deep."""
    have = lambda x, t: F.col(x) if x in history.columns else F.lit(None).cast(t)
    none = F.array().cast("array<string>")
    details = {"shapValues": have("shap_values", "string"), "metadata": have("features_json", "string"), "explanations": F.coalesce(have("explanations", "array<string>"), none), "evidenceSummary": F.coalesce(have("evidence_summary", "array<string>"), none), "deepScan": F.coalesce(have("deep_scan", "boolean"), F.lit(False))}
    return history.select("id", F.col("scan_type").alias("type"), F.col("input_value").alias("input"), F.col("risk_score").alias("score"), display_status(F.col("threat_label")).alias("status"), F.col("created_at").alias("timestamp"), F.struct(*(v.alias(k) for k, v in details.items())).alias("details"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One row a scan: the latest, by time and then id."""
    w = W.partitionBy("scan_id").orderBy(F.desc("created_at"), F.desc("feedback_id"))
    return feedback.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def feedback_counts(feedback: DataFrame, history: DataFrame) -> DataFrame:
    """Per owner: corrections, false alarms and misses."""
    both = feedback.join(history.select(F.col("id").alias("scan_id"), "user_id", "threat_label"), "scan_id").where("user_id is not null")
    alarm = (F.col("correction") == "safe") & (F.col("threat_label") != "Safe")
    miss = (F.col("correction") == "malicious") & (F.col("threat_label") == "Safe")
    return both.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(alarm).alias("false_alarms"), F.count_if(miss).alias("misses"))


def corrected(feedback: DataFrame, history: DataFrame, copies: int, least: int) -> DataFrame:
    """Corrections as training rows with a weight; suspicious ones say nothing. Fewer than `least` corrections give none."""
    label = F.when(F.col("correction") == "safe", 0).when(F.col("correction") == "malicious", 1)
    rows = feedback.join(history.where("scan_type = 'url' and input_value is not null").select(F.col("id").alias("scan_id"), "input_value"), "scan_id").withColumn("is_phishing", label).where("is_phishing is not null")
    enough = rows.agg((F.count("*") >= least).alias("enough"))
    return rows.join(F.broadcast(enough), F.col("enough")).select("scan_id", "input_value", "is_phishing", F.lit(copies).alias("weight"))


def without(history: DataFrame, ids: DataFrame) -> DataFrame:
    """History after the deletion of an owner's own rows; ids: id, user_id."""
    return history.join(ids, (history["id"] == ids["id"]) & (history["user_id"] == ids["user_id"]), "left_anti")


def _in_order(rows: DataFrame, key: str, step: Callable[..., tuple], schema: str, names: list[str]) -> DataFrame:
    """A fold over each key's rows in the order of time and id.

    Rows are dealt by key and sorted by Spark, which spills; Python sees one batch at
    a time and keeps the state of the current key alone, so a key with a large part
    of all rows needs no more memory than any other.
    """
    schema_of_key = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), {}
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = []
            for k, t in zip(keys, times, strict=True):
                if k != current:
                    current, state = k, {}
                made.append(step(state, t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([m[i] for m in made], t) for i, t in enumerate(_ARROW[x] for x in schema.split(",")))], names=[key, "event_id", *names])

    ordered = rows.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").repartition(key).sortWithinPartitions(key, "t", "event_id")
    return ordered.mapInArrow(run, f"{key} {schema_of_key}, event_id long, " + ", ".join(f"{n} {t}" for n, t in zip(names, schema.split(","), strict=True)))


_ARROW = {"boolean": pa.bool_(), "long": pa.int64()}


def admitted(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The greedy limiter, per user: rejected requests are not counted later. State: the at most `limit` admitted times of the window."""
    window = window_seconds * 1_000_000

    def step(state: dict, t: int) -> tuple:
        seen = state.setdefault("open", deque())
        while seen and seen[0] < t - window:
            seen.popleft()
        if len(seen) < limit:
            seen.append(t)
            return True, None
        return False, max(1, (seen[0] + window - t) // 1_000_000 + 1)

    return _in_order(requests, "user_id", step, "boolean,long", ["admitted", "retry_after"])


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds hit: the cached row is there and has not run out; no expiry means valid, and the last moment still is."""
    fresh = cache.select("domain", "expires_at", F.lit(True).alias("there"))
    out = requests.join(fresh, "domain", "left")
    return out.withColumn("hit", F.coalesce(F.col("there") & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("ts"))), F.lit(False))).drop("there")


def cache_misses(requests: DataFrame, days: int, known: Column | None = None) -> DataFrame:
    """domain, event_id and miss of each request: whether it probes anew. Hits do not extend what is stored, and a probe that is not `known` (it failed) is not stored.

    The stored probes of a domain are a chain: after one, the first known request beyond
    its time to live. So they are found by pointers from every known request to that one
    and by pointer doubling, in rounds that grow with the logarithm of the time covered;
    a domain with a large part of all requests is no serial work. A request is a hit if
    the one stored probe that can cover it does. Requests without a domain or a time
    always probe and store nothing. Equal times go by event_id.
    """
    ttl = days * 86_400_000_000
    stored = F.lit(True) if known is None else F.coalesce(known, F.lit(False))
    rows = scratch.checkpoint(requests.select("domain", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), stored.alias("stored")))
    points = scratch.checkpoint(rows.where("stored and domain is not null and t is not null").groupBy("domain", "t").agg(F.min("event_id").alias("by")))
    low, high = points.agg(F.min("t"), F.max("t")).first()
    most = (high - low) // ttl + 1 if low is not None else 1
    edges = prefix.following(points, points.select("domain", "t", (F.col("t") + ttl).alias("until")), ["domain"], "t", "until").select("domain", "t", "next")
    kept = prefix.on_chains(points, edges, ["domain"], "t", most).join(points, ["domain", "t"])
    # two stored probes lie more than a time to live apart: one at most in each slot of that length
    slot = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(ttl))
    held = kept.select("domain", slot("t").alias("__slot"), F.col("t").alias("__t"), F.col("by").alias("__by"))
    before = held.select("domain", (F.col("__slot") + ttl).alias("__slot"), F.col("__t").alias("__t1"))
    joined = rows.withColumn("__slot", slot("t")).join(held, ["domain", "__slot"], "left").join(before, ["domain", "__slot"], "left")
    own = (F.col("__t") < F.col("t")) | ((F.col("__t") == F.col("t")) & (F.col("__by") < F.col("event_id")))
    hit = F.coalesce(own, F.lit(False)) | F.coalesce(F.col("__t1") + ttl >= F.col("t"), F.lit(False))
    return joined.select("domain", "event_id", (~hit).alias("miss"))
