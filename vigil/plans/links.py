"""Link harvest over pages with a few more link forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import links as L

EXTRA = ["", "<a href='https://other.site.org/x'>o</a>", "<a class=k href=\"?page=9\">q</a>", "<!-- <a href='/hidden'>h</a> --><a href='#top'>t</a>", "<a href='mailto:a@b.c'>m</a><a href='next.html'>n</a>", "<a href='//cdn.example.net:8080/lib'>c</a>"]
_q = lambda x: "'" + x.replace("'", "''") + "'"


def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*map(F.lit, EXTRA)), (F.col("page_id") % len(EXTRA) + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat(extra, "html").alias("html"))
    return L.with_inner_links(pages).select("page_id", F.posexplode("links").alias("place", "link")).withColumn("place", F.col("place") + 1)


_part = lambda x, k: f"regexp_extract({x}, {_q(L.BASE)}, {k})"
_host = lambda x: f"lower(regexp_replace(regexp_replace({_part(x, 2)}, '^.*@', ''), ':[0-9]*$', ''))"
ORACLE = {
    "link_harvest": rf"""WITH h AS (SELECT page_id, {_part("url", 1)} || '://' || {_part("url", 2)} AS site, {_part("url", 1)} AS scheme, {_part("url", 3)} AS path, {_part("url", 4)} AS query, {_host("url")} AS host,
      list_transform(regexp_extract_all(regexp_replace([{", ".join(map(_q, EXTRA))}][page_id % {len(EXTRA)} + 1] || html, {_q(L.UNSEEN)}, ' ', 'g'), {_q(L.HREF)}, 1), lambda x: trim(x)) AS hrefs FROM pages),
      a AS (SELECT page_id, host, list_transform(hrefs, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x WHEN starts_with(x, '/') THEN site || x
        WHEN starts_with(x, '?') THEN site || path || x WHEN x = '' OR starts_with(x, '#') THEN site || path || query || x ELSE site || regexp_replace(path, '[^/]*$', '') || x END) AS links FROM h),
      k AS (SELECT page_id, list_filter(links, lambda x: regexp_matches(x, '^(?i)https?://') AND {_host("x")} <> '' AND (contains({_host("x")}, host) OR contains(host, {_host("x")})) AND (regexp_matches({_part("x", 3)}, '[^/]') OR len(string_split({_host("x")}, '.')) > 2)) AS kept FROM a),
      u AS (SELECT page_id, list_filter(kept, lambda x, i: list_position(kept, x) = i)[1:{L.MOST}] AS first FROM k)
      SELECT page_id, CAST(unnest(range(1, len(first) + 1)) AS INTEGER) AS place, unnest(first) AS link FROM u""",
}
QUERIES = {"link_harvest": link_harvest}
