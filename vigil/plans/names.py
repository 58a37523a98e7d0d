"""Names and words of given tables against hosts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import dictionaries as D
from vigil.operators import names as N

NAMED = [b for b in D.BRANDS if len(b) >= 6]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.lower("text").alias("text"))


def name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of page hosts, and brands with a letter changed by a page's number, against brands and the labels of other hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    labels = pages.select("page_id", F.explode(F.split("host", r"\.")).alias("text"))
    brand = F.element_at(F.array(*map(F.lit, NAMED)), (F.col("page_id") % len(NAMED) + 1).cast("int"))
    at = (F.col("page_id") % 6).cast("int")
    changed = pages.select("page_id", F.concat(F.left(brand, at), F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "x").otherwise("yz"), F.substring(brand, at + 2, F.length(brand))).alias("text"))
    names = spark.createDataFrame([(b,) for b in NAMED], "name string").unionByName(labels.where("length(text) = 6").select(F.col("text").alias("name")))
    return N.nearest(labels.unionByName(changed).distinct(), names).select("page_id", "text", "name", "distance")


def words_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of conversations, of six to twelve letters, in every page."""
    words = _texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) between 6 and 12").distinct()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower("html").alias("html"))
    return N.contained(pages, "html", words).select("page_id", "n_words")


_LABELS = "l AS (SELECT page_id, unnest(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')) AS text FROM pages)"
_BRANDS = ", ".join(f"'{b}'" for b in NAMED)
ORACLE = {
    "name_distances": f"""WITH {_LABELS}, b AS (SELECT page_id, [{_BRANDS}][page_id % {len(NAMED)} + 1] AS brand, page_id % 6 AS k FROM pages),
      t AS (SELECT * FROM l UNION SELECT page_id, left(brand, k) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'yz' END || substr(brand, k + 2) FROM b),
      n AS (SELECT unnest([{_BRANDS}]) AS name UNION SELECT text FROM l WHERE length(text) = 6),
      d AS (SELECT text, name, levenshtein(text, name) AS distance FROM (SELECT DISTINCT text FROM t), n),
      best AS (SELECT * FROM d WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY text ORDER BY distance, name) = 1)
      SELECT page_id, t.text, name, CAST(distance AS INTEGER) AS distance FROM t LEFT JOIN best USING (text)""",
    "words_contained": "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) WHERE length(word) BETWEEN 6 AND 12), p AS (SELECT page_id, lower(html) AS html FROM pages) SELECT page_id, count(word) AS n_words FROM p LEFT JOIN w ON contains(html, word) GROUP BY page_id",
}
QUERIES = {f.__name__: f for f in (name_distances, words_contained)}
