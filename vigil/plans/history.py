"""History queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import dataset as D
from vigil.operators import history as H

COPIES, LEAST = 50, 10

def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scan history: some rows have no owner."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.when(F.col("event_type") == "error", "Malicious").when(F.col("event_type") == "signup", "Suspicious").otherwise("Safe")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 3 == 0, "email").otherwise("url").alias("scan_type"), F.concat(F.lit("Host"), F.pmod("event_id", F.lit(50)), F.lit(".example.com")).alias("input_value"), F.round(F.pmod("event_id", F.lit(101)) / 100, 4).alias("risk_score"), label.alias("threat_label"), F.col("ts").alias("created_at"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    said = F.element_at(F.array(F.lit("safe"), F.lit("suspicious"), F.lit("malicious")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("feedback_id"), (F.col("event_id") - F.col("event_id") % 10).alias("scan_id"), said.alias("correction"), F.col("ts").alias("created_at"))


HISTORY_SQL = """history AS (SELECT event_id AS id, CASE WHEN event_id % 17 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN 'email' ELSE 'url' END AS scan_type,
  'Host' || (event_id % 50) || '.example.com' AS input_value, round(CAST(event_id % 101 AS DOUBLE) / 100, 4) AS risk_score,
  CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'signup' THEN 'Suspicious' ELSE 'Safe' END AS threat_label, ts AS created_at FROM events),
feedback AS (SELECT event_id AS feedback_id, event_id - event_id % 10 AS scan_id, ['safe', 'suspicious', 'malicious'][event_id % 3 + 1] AS correction, ts AS created_at FROM events WHERE event_type = 'click'),
latest AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY created_at DESC, feedback_id DESC) = 1)"""


def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.label_counts(history(spark, sf_dir))


def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.recent(history(spark, sf_dir), 7, 8).select("id", "user_id", "threat_label", H.display_status(F.col("threat_label")).alias("status"), H.percent(F.col("risk_score")).alias("percent"))


def history_recent_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.recent_by_owner(history(spark, sf_dir), 8).select("id", "user_id", "place", "threat_label")


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.search(history(spark, sf_dir), "url", "Malicious", "HOST1").select("id", "input_value", H.snippet(F.col("input_value")).alias("snippet"))


def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.owned(history(spark, sf_dir), 7).select("id", "threat_label")


def history_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    gone = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'view'").select(F.col("event_id").alias("id"), (F.col("user_id") + F.when(F.col("event_id") % 2 == 0, 0).otherwise(1)).alias("user_id"))
    return H.without(h, gone).select("id", "threat_label")


def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_feedback(feedback(spark, sf_dir)).select("scan_id", "feedback_id", "correction")


def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.feedback_counts(H.latest_feedback(feedback(spark, sf_dir)), history(spark, sf_dir))


def retrain_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.corrected(H.latest_feedback(feedback(spark, sf_dir)), history(spark, sf_dir), COPIES, LEAST)


def history_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some scans have explanations, some are deep, the others say nothing of either."""
    flagged, bought = F.col("threat_label") != "Safe", F.pmod("id", F.lit(5)) == 0
    rows = history(spark, sf_dir).withColumn("explanations", F.when(flagged, F.array("threat_label", "scan_type"))).withColumn("deep_scan", F.when(bought, True))
    return H.shown(rows).select("id", "type", "input", "score", "status", "timestamp", F.array_join("details.explanations", ",").alias("explanations"), F.size("details.evidenceSummary").alias("n_evidence"), F.col("details.deepScan").alias("deep"))


FEATURES = ["name_length", "digits", "strength"]


def _backfill(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labelled table and corrections whose features may be incomplete: old scans lack the last one."""
    named = [F.length("input_value").cast("double").alias("name_length"), F.regexp_count("input_value", F.lit("[0-9]")).cast("double").alias("digits")]
    h = history(spark, sf_dir)
    base = h.where("scan_type = 'url'").select(F.col("input_value").alias("url"), *named, F.col("risk_score").alias("strength"), (F.col("threat_label") != "Safe").cast("int").alias("is_phishing"))
    old = h.select(F.col("id").alias("scan_id"), F.when(F.col("risk_score") < 0.8, F.col("risk_score")).alias("strength"))
    fixed = H.corrected(H.latest_feedback(feedback(spark, sf_dir)), h, COPIES, LEAST).join(old, "scan_id")
    return base, fixed.select(F.col("input_value").alias("url"), *named, "strength", "is_phishing")


def retrain_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.backfilled(*_backfill(spark, sf_dir), FEATURES, COPIES, LEAST)


def retrain_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.backfill_preview(*_backfill(spark, sf_dir), FEATURES, COPIES, LEAST)


LIMIT, WINDOW_S = 3, 6 * 3600


def limiter_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.admitted(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts"), LIMIT, WINDOW_S)


def _domain_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("d"), F.col("user_id"), F.lit(".com")).alias("domain"), "event_id", "ts")


def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of errors failed: they store nothing."""
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("d"), F.col("user_id"), F.lit(".com")).alias("domain"), "event_id", "ts", "event_type")
    return H.cache_misses(requests, 7, F.col("event_type") != "error")


def cache_lookup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _domain_requests(spark, sf_dir)
    cache = requests.groupBy("domain").agg(F.min("ts").alias("first")).where(F.substring("domain", 2, 1) != "9").select("domain", F.when(F.substring("domain", 2, 1) != "8", F.col("first") + F.expr("interval 7 days")).alias("expires_at"))
    return H.cache_lookup(requests, cache).select("domain", "event_id", "hit")


_BACKFILL = f"""{HISTORY_SQL}, named AS (SELECT *, CAST(length(input_value) AS DOUBLE) AS name_length, CAST(length(regexp_replace(input_value, '[^0-9]', '', 'g')) AS DOUBLE) AS digits FROM history WHERE scan_type = 'url'),
  base AS (SELECT input_value AS url, name_length, digits, risk_score AS strength, CAST(threat_label <> 'Safe' AS INTEGER) AS is_phishing FROM named),
  fixed AS (SELECT input_value AS url, name_length, digits, CASE WHEN risk_score < 0.8 THEN risk_score END AS strength, CASE correction WHEN 'safe' THEN 0 ELSE 1 END AS is_phishing FROM latest JOIN named ON scan_id = id WHERE correction IN ('safe', 'malicious')),
  whole AS (SELECT * FROM fixed WHERE strength IS NOT NULL), ok AS (SELECT (SELECT count(*) FROM whole) >= {LEAST} AS ok)"""
_ORDERED = "SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
ORACLE = {
    "history_stats": f"WITH {HISTORY_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (threat_label = 'Safe') AS safe, count(*) FILTER (threat_label = 'Suspicious') AS suspicious, count(*) FILTER (threat_label = 'Malicious') AS malicious, count(*) FILTER (threat_label <> 'Safe') AS threats, count(*) FILTER (threat_label = 'Malicious') AS dangerous FROM history WHERE user_id IS NOT NULL GROUP BY user_id",
    "history_recent": f"WITH {HISTORY_SQL} SELECT id, user_id, threat_label, lower(threat_label) AS status, CAST(floor(risk_score * 100 + 0.5) AS BIGINT) AS percent FROM history WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 8",
    "history_recent_by_owner": f"WITH {HISTORY_SQL}, r AS (SELECT id, user_id, threat_label, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM history WHERE user_id IS NOT NULL) SELECT id, user_id, place, threat_label FROM r WHERE place <= 8",
    "history_search": f"WITH {HISTORY_SQL} SELECT id, input_value, left(input_value, 200) AS snippet FROM history WHERE scan_type = 'url' AND threat_label = 'Malicious' AND contains(lower(input_value), 'host1')",
    "history_lookup": f"WITH {HISTORY_SQL} SELECT id, threat_label FROM history WHERE user_id = 7",
    "history_delete": f"WITH {HISTORY_SQL}, gone AS (SELECT event_id AS id, user_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS user_id FROM events WHERE event_type = 'view') SELECT id, threat_label FROM history h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = h.id AND g.user_id = h.user_id)",
    "feedback_latest": f"WITH {HISTORY_SQL} SELECT scan_id, feedback_id, correction FROM latest",
    "feedback_stats": f"WITH {HISTORY_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (correction = 'safe' AND threat_label <> 'Safe') AS false_alarms, count(*) FILTER (correction = 'malicious' AND threat_label = 'Safe') AS misses FROM latest JOIN history ON scan_id = id WHERE user_id IS NOT NULL GROUP BY user_id",
    "retrain_set": f"WITH {HISTORY_SQL}, r AS (SELECT scan_id, input_value, CASE correction WHEN 'safe' THEN 0 WHEN 'malicious' THEN 1 END AS is_phishing FROM latest JOIN history ON scan_id = id WHERE scan_type = 'url') SELECT scan_id, input_value, is_phishing, 50 AS weight FROM r WHERE is_phishing IS NOT NULL AND (SELECT count(is_phishing) FROM r) >= 10",
    "retrain_backfill": f"WITH {_BACKFILL} SELECT * FROM base UNION ALL SELECT whole.* FROM whole, range({COPIES}) WHERE (SELECT ok FROM ok)",
    "retrain_preview": f"""WITH {_BACKFILL}, c AS (SELECT (SELECT CASE WHEN count(*) >= {LEAST} THEN count(*) ELSE 0 END FROM fixed) AS given, (SELECT count(*) FROM fixed WHERE is_phishing = 0) AS safe, (SELECT count(*) FROM fixed WHERE is_phishing = 1) AS dangerous, (SELECT count(*) FROM whole) AS usable, (SELECT count(*) FROM base) AS base)
      SELECT c.*, CASE WHEN ok THEN usable * {COPIES} ELSE 0 END AS added, base + CASE WHEN ok THEN usable * {COPIES} ELSE 0 END AS total FROM c, ok""",
    "history_shown": f"WITH {HISTORY_SQL} SELECT id, scan_type AS type, input_value AS input, risk_score AS score, lower(threat_label) AS status, created_at AS timestamp, CASE WHEN threat_label <> 'Safe' THEN threat_label || ',' || scan_type ELSE '' END AS explanations, CAST(0 AS INTEGER) AS n_evidence, id % 5 = 0 AS deep FROM history",
    "limiter_greedy": f"""WITH RECURSIVE o AS ({_ORDERED}), s AS (
      SELECT user_id, event_id, n, TRUE AS admitted, CAST(NULL AS BIGINT) AS retry_after, [t] AS live FROM o WHERE n = 1
      UNION ALL
      SELECT o.user_id, o.event_id, o.n, len(k.live) < {LIMIT}, CASE WHEN len(k.live) >= {LIMIT} THEN greatest(CAST(floor((k.live[1] + {WINDOW_S}000000 - o.t) / 1000000.0) AS BIGINT) + 1, 1) END, CASE WHEN len(k.live) < {LIMIT} THEN list_append(k.live, o.t) ELSE k.live END
      FROM (SELECT s.user_id, s.n, o2.t AS now, list_filter(s.live, lambda x: x >= o2.t - {WINDOW_S}000000) AS live FROM s JOIN o o2 ON o2.user_id = s.user_id AND o2.n = s.n + 1) k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1)
      SELECT user_id, event_id, admitted, retry_after FROM s""",
    "cache_store": f"""WITH RECURSIVE o AS (SELECT o.*, event_type <> 'error' AS known FROM ({_ORDERED}) o JOIN events USING (event_id)), s AS (
      SELECT user_id, event_id, n, TRUE AS miss, CASE WHEN known THEN t + 604800000000 ELSE -1 END AS until FROM o WHERE n = 1
      UNION ALL
      SELECT o.user_id, o.event_id, o.n, s.until < o.t, CASE WHEN s.until < o.t AND known THEN o.t + 604800000000 ELSE s.until END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
      SELECT 'd' || user_id || '.com' AS domain, event_id, miss FROM s""",
    "cache_lookup_ttl": "WITH r AS (SELECT 'd' || user_id || '.com' AS domain, event_id, ts FROM events), c AS (SELECT domain, CASE WHEN substr(domain, 2, 1) <> '8' THEN min(ts) + INTERVAL 7 DAY END AS expires_at FROM r WHERE substr(domain, 2, 1) <> '9' GROUP BY domain) SELECT r.domain, event_id, c.domain IS NOT NULL AND (expires_at IS NULL OR expires_at >= ts) AS hit FROM r LEFT JOIN c ON r.domain = c.domain",
}
QUERIES = {f.__name__: f for f in (history_stats, history_recent, history_recent_by_owner, history_search, history_lookup, history_delete, feedback_latest, feedback_stats, retrain_set, retrain_backfill, retrain_preview, history_shown, limiter_greedy, cache_store, cache_lookup_ttl)}
