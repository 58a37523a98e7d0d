"""Evidence queries: requests for pages and seeds, a cache of some of their domains, probes of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import pages as P
from vigil.operators import evidence as V
from vigil.operators import guard as G
from vigil.plans import urls

NOW = "2024-06-01 00:00:00"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.hosts(spark, sf_dir)
    return rows.select("id", F.col("registered").alias("domain"), F.to_timestamp(F.lit(NOW)).alias("ts"), G.blocked(rows).alias("blocked"))


def _probes(rows: DataFrame) -> DataFrame:
    """Long names answer; the age of some and the certificate of some others stay unknown."""
    n = F.length("domain")
    return rows.select(*rows.columns, F.when(n > 12, n * 100).alias("age_days"), F.when(n % 3 != 0, F.concat(F.lit("9.9.9."), n)).alias("ip"), (n % 2 == 0).alias("has_certificate"), F.lit("moves").alias("status_text"))


def _cache(requests: DataFrame) -> DataFrame:
    """Domains before `p` are stored, those before `f` for good, those before `k` until the moment asked for, the others ran out."""
    first = F.substring("domain", 1, 1)
    stored = V.storable(_probes(requests.where("domain < 'p'").select("domain").distinct()))
    until = F.when(first < "f", F.lit(None).cast("timestamp")).when(first < "k", F.to_timestamp(F.lit(NOW))).otherwise(F.to_timestamp(F.lit("2024-05-31 23:59:59")))
    return stored.select("domain", until.alias("expires_at"), "part")


def evidence_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    pages = P.with_page_features(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "html"))
    probes = _probes(requests).select("id", "age_days", F.lit("Reg").alias("registrar"), "ip", "has_certificate")
    out = V.assembled(requests, _cache(requests), probes, pages.select("id", "forms", F.lit(True).alias("readable")))
    return out.select("id", "domain", "from_cache", "age_days", "registrar", "ip", "has_certificate", "forms", "readable", F.array_join("failures", ",").alias("failures"))


def evidence_storable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.storable(_probes(_requests(spark, sf_dir).select("domain").distinct()))
    return rows.select("domain", "part.age_days", "part.registrar", "part.ip", "part.has_certificate", F.size(F.array_compact(F.array(*(F.col(f"part.{k}").cast("string") for k in V.STABLE)))).alias("known"))


def dataset_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.readable_only(evidence_assembled(spark, sf_dir)).select("id", "domain")


_BLOCKED = """blocked AS (SELECT id, regexp_extract(text, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, TRY_CAST(regexp_extract(authority, ':([0-9]+)$', 1) AS INTEGER) AS port FROM hosts),
"""
_GUARD = rf"""r AS (SELECT h.id, registered AS domain, CASE WHEN lower(scheme) NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN contains(authority, ':') AND (port IS NULL OR port NOT IN ({", ".join(map(str, G.PORTS))})) THEN 'port'
  WHEN host = 'localhost' OR starts_with(host, '192.168.') OR starts_with(host, '999.') THEN 'not public' WHEN NOT is_ip AND NOT regexp_matches(host, '^[a-z0-9_\-\p{{L}}\p{{M}}]+(\.[a-z0-9_\-\p{{L}}\p{{M}}]+)*$') THEN 'host' END AS blocked FROM hosts h JOIN blocked b USING (id)),
"""
_PARTS = "CASE WHEN length(domain) > 12 THEN length(domain) * 100 END AS age_days, CASE WHEN length(domain) % 3 <> 0 THEN '9.9.9.' || length(domain) END AS ip, length(domain) % 2 = 0 AS has_certificate"
_ASSEMBLED = f"""{urls.HOSTS_SQL}, {_BLOCKED} {_GUARD}
  p AS (SELECT *, {_PARTS}, domain <> '' AND domain < 'k' AND (length(domain) > 12 OR length(domain) % 3 <> 0) AS hit, h.page_id IS NOT NULL AS seen, CASE WHEN h.page_id IS NOT NULL THEN CAST(len(regexp_extract_all(lower(coalesce(html, '')), '<form\\b')) AS INTEGER) END AS forms FROM r LEFT JOIN pages h ON h.page_id = r.id),
  a AS (SELECT id, domain, CASE WHEN blocked IS NULL THEN hit END AS from_cache, CASE WHEN blocked IS NULL THEN age_days END AS age_days, CASE WHEN blocked IS NULL AND NOT hit THEN 'Reg' END AS registrar, CASE WHEN blocked IS NULL THEN ip END AS ip, CASE WHEN blocked IS NULL THEN has_certificate END AS has_certificate,
    CASE WHEN blocked IS NULL THEN forms END AS forms, CASE WHEN blocked IS NULL AND seen THEN TRUE END AS readable, CASE WHEN blocked IS NOT NULL THEN 'blocked: ' || blocked WHEN NOT seen THEN 'no page' ELSE '' END AS failures FROM p)"""
ORACLE = {
    "evidence_assembled": f"WITH {_ASSEMBLED} SELECT * FROM a",
    "dataset_readable": f"WITH {_ASSEMBLED} SELECT id, domain FROM a WHERE readable",
    "evidence_storable": f"WITH {urls.HOSTS_SQL}, d AS (SELECT DISTINCT registered AS domain FROM hosts WHERE registered <> ''), p AS (SELECT domain, {_PARTS} FROM d) SELECT domain, age_days, CAST(NULL AS VARCHAR) AS registrar, ip, has_certificate, CAST(1 + CAST(age_days IS NOT NULL AS INTEGER) + CAST(ip IS NOT NULL AS INTEGER) AS INTEGER) AS known FROM p WHERE age_days IS NOT NULL OR ip IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (evidence_assembled, evidence_storable, dataset_readable)}
