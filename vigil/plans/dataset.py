"""Dataset and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import dataset as D
from vigil.operators import evaluation as E


def _hosts(spark: SparkSession, sf_dir: str, bad: bool) -> DataFrame:
    """Hosts made of whole keys: three keys in a row share a bad one, two a legitimate one."""
    name, key = ("orders", "o_orderkey") if bad else ("customer", "c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).alias("key"))
    number = F.floor(F.col("key") / 3) if bad else F.floor(F.col("key") / 2) * 2
    raw = F.concat(F.lit("HTTPS://www.Host"), number, F.lit(".com:80/p?q"))
    return rows.select("key", D.clean_host(raw).alias("host"), F.lit(1 if bad else 0).alias("label"))


def dataset_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.systematic_sample(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", 400).select("c_custkey", "place")


def dataset_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.without_shared_hosts(_hosts(spark, sf_dir, True), _hosts(spark, sf_dir, False)).select("key", "host")


def dataset_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = D.first_by_host(_hosts(spark, sf_dir, True), "key").unionByName(D.first_by_host(_hosts(spark, sf_dir, False), "key"))
    return D.without_conflicts(both).where("length(host) > 3").select("key", "host", "label")


def dataset_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    return D.balanced(rows, "toxic", "doc_id", 42).select("doc_id", "toxic")


def dataset_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    text = F.when(p % 7 == 0, "# note").when(p % 7 == 1, "").when(p % 7 == 2, F.concat(F.lit("http://10.0.0."), p % 250, F.lit("/x"))).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    return D.feed_lines(spark.read.parquet(f"{sf_dir}/pages.parquet").select(p.alias("line"), text.alias("value")))


_AUDIT = ["l_linenumber", "flag", "l_quantity"]


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag"), "l_quantity", F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 45), 1).otherwise(0).alias("y"), F.concat(F.lit("u"), F.col("l_partkey")).alias("url"))


def leakage_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.separators(_audit(spark, sf_dir), _AUDIT, "y")


def leakage_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicates(_audit(spark, sf_dir), "url", "y")


def leakage_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.best_cuts(_audit(spark, sf_dir), _AUDIT, "y")


def leakage_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on held-out fifths; rows are dealt by part."""
    return D.strongest_features(D.held_out_cuts(_audit(spark, sf_dir), _AUDIT, "y", F.pmod(F.substring("url", 2, 20).cast("long"), F.lit(5)).cast("int")))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null")
    return rows.select(F.col("toxic").alias("y"), ((F.col("doc_id") * 37 % 101 + F.col("toxic") * 40) / 141.0).alias("raw")).select("y", F.round("raw", 4).alias("score"))


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_scored(spark, sf_dir))


def eval_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confident(_scored(spark, sf_dir))


def eval_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_threshold(_scored(spark, sf_dir), 0.98)


def eval_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.auc(_scored(spark, sf_dir))


TARGETS = 300


def dataset_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, then orders, some of them at raw addresses, against pages."""
    first = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("line"), F.concat(F.lit("http://s"), "s_suppkey", F.lit(".com/a")).alias("url"))
    raw = F.when(F.col("o_orderstatus") == "F", "http://10.0.0.1/x").otherwise(F.concat(F.lit("http://o"), "o_orderkey", F.lit(".net/b")))
    second = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line"), raw.alias("url"))
    return D.targets(first, second, spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("line"), "url"), TARGETS)


def eval_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fast label from the score, a deep one from the score moved towards the truth."""
    level = lambda x: F.when(x >= 0.7, "Malicious").when(x >= 0.4, "Suspicious").otherwise("Safe")
    return E.compared(_scored(spark, sf_dir).select("y", level(F.col("score")).alias("fast"), level(F.col("score") + F.col("y") * 0.3 - 0.1).alias("deep")))


_PHISH = "SELECT o_orderkey AS key, 'host' || (o_orderkey // 3) || '.com' AS host, 1 AS label FROM orders"
_LEGIT = "SELECT c_custkey AS key, 'host' || (c_custkey // 2 * 2) || '.com' AS host, 0 AS label FROM customer"
_ROWS = "rows AS (SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_returnflag = 'R' AS DOUBLE) AS flag, l_quantity, CAST(l_returnflag = 'R' OR l_quantity > 45 AS INTEGER) AS y, 'u' || l_partkey AS url FROM lineitem)"
_LONG = _ROWS + ", long AS (SELECT 'l_linenumber' AS feature, l_linenumber AS value, y FROM rows UNION ALL SELECT 'flag', flag, y FROM rows UNION ALL SELECT 'l_quantity', l_quantity, y FROM rows), each AS (SELECT feature, value, count(*) AS n, avg(y) AS rate, sum(y) AS bad FROM long GROUP BY ALL)"
_SCORES = "s AS (SELECT toxic AS y, round(CAST(doc_id * 37 % 101 + toxic * 40 AS DOUBLE) / 141.0, 4) AS score FROM labels WHERE toxic IS NOT NULL)"
ORACLE = {
    "dataset_sample": "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place, greatest(1, count(*) OVER () // 400) AS k FROM customer) SELECT c_custkey, place FROM r WHERE (place - 1) % k = 0 AND place <= k * 400",
    "dataset_antijoin": f"WITH p AS ({_PHISH}), l AS ({_LEGIT}) SELECT key, host FROM p WHERE host NOT IN (SELECT host FROM l)",
    "dataset_dedupe": f"WITH p AS ({_PHISH} QUALIFY row_number() OVER (PARTITION BY host ORDER BY key) = 1), l AS ({_LEGIT} QUALIFY row_number() OVER (PARTITION BY host ORDER BY key) = 1), b AS (SELECT * FROM p UNION ALL SELECT * FROM l) SELECT key, host, label FROM b WHERE length(host) > 3 QUALIFY count(*) OVER (PARTITION BY host) = 1",
    "dataset_balance": "WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY (doc_id * 7919 + 42) % 1000003, doc_id) AS place FROM labels WHERE toxic IS NOT NULL) SELECT doc_id, toxic FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic))",
    "dataset_feed": "SELECT page_id AS line, trim(url) AS url FROM pages WHERE page_id % 7 > 2 AND regexp_matches(trim(url), '^https?://')",
    "leakage_separators": f"WITH {_LONG}, few AS (SELECT feature, sum(n) AS total FROM each GROUP BY feature HAVING count(*) <= 10) SELECT feature, value, n, rate, n >= greatest(50, floor(total / 100)) AS severe FROM each JOIN few USING (feature) WHERE n >= 50 AND rate IN (0, 1)",
    "leakage_duplicates": f"WITH {_ROWS}, e AS (SELECT url, count(*) AS n, count(DISTINCT y) AS k FROM rows GROUP BY url) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (k > 1) AS conflicts FROM e",
    "leakage_stumps": f"WITH {_LONG}, run AS (SELECT feature, sum(n) OVER u AS n, sum(bad) OVER u AS bad, sum(n) OVER a AS all_n, sum(bad) OVER a AS all_bad FROM each WINDOW u AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature)), r AS (SELECT feature, n - bad + all_bad - bad AS ok, all_n FROM run) SELECT feature, round(max(CAST(greatest(ok, all_n - ok) AS DOUBLE) / all_n), 6) AS accuracy FROM r GROUP BY feature",
    "leakage_strongest": f"""WITH {_ROWS}, l AS (SELECT *, CAST(substr(url, 2) AS BIGINT) % 5 AS fold FROM (SELECT 'l_linenumber' AS feature, l_linenumber AS value, y, url FROM rows UNION ALL SELECT 'flag', flag, y, url FROM rows UNION ALL SELECT 'l_quantity', l_quantity, y, url FROM rows)),
      cuts AS (SELECT DISTINCT feature, value AS cut, k, way FROM l, range(5) AS f(k), (VALUES (0), (1)) AS w(way)),
      cells AS (SELECT feature, value, fold, count(*) AS n, sum(y) AS bad FROM l GROUP BY ALL),
      told AS (SELECT feature, cut, k, way, sum(CASE WHEN (value > cut) = (way = 0) THEN bad ELSE n - bad END) FILTER (fold <> k) AS train, coalesce(sum(CASE WHEN (value > cut) = (way = 0) THEN bad ELSE n - bad END) FILTER (fold = k), 0) AS tested, coalesce(sum(n) FILTER (fold = k), 0) AS n FROM cuts JOIN cells USING (feature) GROUP BY feature, cut, k, way),
      best AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY feature, k ORDER BY train DESC, cut, way) = 1)
      SELECT feature, round(avg(CAST(tested AS DOUBLE) / n), 6) AS accuracy FROM best WHERE n > 0 GROUP BY feature""",
    "dataset_targets": f"""WITH a AS (SELECT 0 AS feed, s_suppkey AS line, 'http://s' || s_suppkey || '.com/a' AS url FROM supplier ORDER BY line LIMIT {TARGETS // 2}),
      b AS (SELECT 1 AS feed, line, url FROM (SELECT o_orderkey AS line, CASE WHEN o_orderstatus = 'F' THEN 'http://10.0.0.1/x' ELSE 'http://o' || o_orderkey || '.net/b' END AS url FROM orders ORDER BY line LIMIT {TARGETS * 2}) WHERE url <> 'http://10.0.0.1/x'),
      m AS (SELECT url, 1 AS is_phishing FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY feed, line LIMIT {TARGETS // 2}), g AS (SELECT url, 0 AS is_phishing FROM pages ORDER BY page_id LIMIT {TARGETS // 2}) SELECT * FROM m UNION ALL SELECT * FROM g""",
    "eval_compared": f"""WITH {_SCORES}, v AS (SELECT (score >= 0.4) = (y = 1) AS f, (score + y * CAST(0.3 AS DOUBLE) - CAST(0.1 AS DOUBLE) >= 0.4) = (y = 1) AS d FROM s), c AS (SELECT count(*) AS n, count(*) FILTER (f) AS right_fast, count(*) FILTER (d) AS right_deep FROM v)
      SELECT *, round(CAST(right_fast AS DOUBLE) / n, 6) AS accuracy_fast, round(CAST(right_deep AS DOUBLE) / n, 6) AS accuracy_deep, right_deep - right_fast AS gained FROM c""",
    "label_counts": f"WITH {_ROWS} SELECT y, count(*) AS n FROM rows GROUP BY y",
    "eval_confusion": f"WITH {_SCORES}, c AS (SELECT count(*) FILTER (score >= 0.4 AND y = 1) AS tp, count(*) FILTER (score >= 0.4 AND y = 0) AS fp, count(*) FILTER (score < 0.4 AND y = 1) AS fn, count(*) FILTER (score < 0.4 AND y = 0) AS tn FROM s) SELECT *, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    "eval_calibration": f"WITH {_SCORES} SELECT threshold, count(*) AS n, round(avg(y), 6) AS precision FROM s JOIN (SELECT CAST(unnest([0.5, 0.7, 0.8, 0.9, 0.95]) AS DOUBLE) AS threshold) ON score >= threshold GROUP BY threshold HAVING count(*) >= 5",
    "eval_threshold": f"WITH {_SCORES}, b AS (SELECT score, sum(y) AS bad FROM s GROUP BY score), r AS (SELECT score, round(CAST(sum(bad) OVER (ORDER BY score DESC) AS DOUBLE) / sum(bad) OVER (), 6) AS recall FROM b) SELECT score, recall FROM r ORDER BY abs(recall - 0.98), score DESC LIMIT 1",
    "eval_auc": f"WITH {_SCORES}, p AS (SELECT score FROM s WHERE y = 1), n AS (SELECT score FROM s WHERE y = 0) SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM p, n",
}
QUERIES = {f.__name__: f for f in (dataset_sample, dataset_antijoin, dataset_dedupe, dataset_balance, dataset_feed, dataset_targets, leakage_separators, leakage_duplicates, leakage_stumps, leakage_strongest, label_counts, eval_confusion, eval_calibration, eval_threshold, eval_auc, eval_compared)}
