"""Redirect chains of page addresses and of seeds worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import redirects as R
from vigil.plans import urls

# What addresses answer: status and location.
ANSWERS: dict[str, tuple[int, str | None]] = {
    "http://loop.example.com/a": (301, "/b"), "http://loop.example.com/b": (302, "a"), "http://in.example.com/": (302, "http://127.0.0.1/x"), "http://127.0.0.1/x": (200, None), "http://plain.example.net": (302, ""), "http://a.one.com/p/q?x=1": (308, "../z#f"), "http://a.one.com/z#f": (404, None),
    "http://b.one.com/": (303, "//www.two.com/"), "http://www.two.com/": (200, None), "http://c.one.com/": (307, "http://9.9.9.9/"), "http://9.9.9.9/": (200, None), "http://d.one.com/": (302, "http://gone.one.com/"), "http://e.one.com/": (304, "http://www.two.com/"), "http://f.one.com/": (302, "ftp://f.one.com/"),
    **{f"http://long{k}.example.com/": (302, f"http://long{k + 1}.example.com/") for k in range(11)}, "http://long11.example.com/": (200, None),
}

# Addresses with final address, status, hops, moved and what ended the chain, by hand.
SEEDS: list[tuple] = [
    ("http://loop.example.com/a", None, None, 10, False, "too many"), ("http://in.example.com/", None, None, 1, False, "blocked: not public"), ("plain.example.net", "http://plain.example.net", 302, 0, False, "read"), ("http://a.one.com/p/q?x=1", "http://a.one.com/z#f", 404, 1, False, "read"),
    ("http://b.one.com/", "http://www.two.com/", 200, 1, True, "read"), ("http://c.one.com/", "http://9.9.9.9/", 200, 1, False, "read"), ("http://d.one.com/", None, None, 1, False, "no answer"), ("http://e.one.com/", "http://e.one.com/", 304, 0, False, "read"), ("http://f.one.com/", None, None, 1, False, "blocked: scheme"),
    ("http://long0.example.com/", None, None, 10, False, "too many"), ("http://long1.example.com/", "http://long11.example.com/", 200, 10, False, "read"), ("http://long1.example.com/", "http://long11.example.com/", 200, 10, False, "read"), ("http://10.0.0.1/", None, None, 0, False, "blocked: not public"), (None, None, None, 0, False, "blocked: scheme"),
]


def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages answer with the next page, a place of their own, another site or the page, by their number; of pages with one address the first answers, but a fixed answer goes before."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    ahead = pages.select((F.col("id") - 1).alias("id"), F.col("url").alias("next"))
    kind = F.col("id") % 6
    location = F.when(kind < 2, F.col("next")).when(kind == 2, F.concat(F.lit("/moved/"), "id")).when(kind == 3, F.lit("https://www.example.org/found")).when(kind == 4, F.lit("//in.example.com/"))
    made = pages.join(ahead, "id", "left").select("id", "url", F.when(kind == 5, 200).otherwise(301 + kind.cast("int") % 3).alias("status"), location.alias("location"))
    known = spark.createDataFrame([(-1, u, s, x) for u, (s, x) in ANSWERS.items()] + [(-1, "https://www.example.org/found", 200, None)], "id long, url string, status int, location string")
    first = made.unionByName(known).groupBy("url").agg(F.min(F.struct("id", "status", "location")).alias("first")).select("url", "first.status", "first.location")
    seeds = spark.createDataFrame([(-1 - k, s[0]) for k, s in enumerate(SEEDS)], "id long, url string")
    got = R.follow(pages.unionByName(seeds), first, urls.suffixes(spark))
    return got.select("id", "final_url", "status", "hops", F.array_join("chain", " ").alias("chain"), "moved", "stop")


def _value(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"


_CHAINS = {0: "", 9: " ".join(f"http://long{k}.example.com/" for k in range(10)), 10: " ".join(f"http://long{k}.example.com/" for k in range(1, 11)), 11: " ".join(f"http://long{k}.example.com/" for k in range(1, 11))}
_CHAINS[0] = " ".join(["http://loop.example.com/a", "http://loop.example.com/b"] * 5)
ORACLE = {
    "redirect_chains": rf"""WITH RECURSIVE a AS (SELECT p.page_id AS id, p.url, p.page_id % 6 AS kind, n.url AS next FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
      given AS (SELECT id, url, CASE WHEN kind = 5 THEN 200 ELSE 301 + kind % 3 END AS status, CASE WHEN kind < 2 THEN next WHEN kind = 2 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/moved/' || id WHEN kind = 3 THEN 'https://www.example.org/found' WHEN kind = 4 THEN regexp_extract(url, '^[a-z]+:') || '//in.example.com/' END AS goes FROM a
        UNION ALL VALUES (-1, 'https://www.example.org/found', 200, NULL), (-1, 'http://in.example.com/', 302, 'http://127.0.0.1/x')),
      answers AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
      walk AS (SELECT page_id AS id, url, [] :: VARCHAR[] AS chain FROM pages UNION ALL SELECT w.id, s.goes, list_append(w.chain, w.url) FROM walk w JOIN answers s ON w.url = s.url WHERE s.goes IS NOT NULL AND len(w.chain) < 10),
      ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(chain) DESC) = 1),
      told AS (SELECT e.*, s.status, CASE WHEN e.url = 'http://127.0.0.1/x' THEN 'blocked: not public' WHEN s.url IS NULL THEN 'no answer' WHEN s.goes IS NULL THEN 'read' ELSE 'too many' END AS stop, regexp_extract(p.url, '([a-z]+\.[a-z]+)(/|$)', 1) AS here, regexp_extract(e.url, '([a-z]+\.[a-z]+)(/|$)', 1) AS there FROM ends e JOIN pages p ON p.page_id = e.id LEFT JOIN answers s ON s.url = e.url)
      SELECT id, CASE WHEN stop = 'read' THEN url END AS final_url, CASE WHEN stop = 'read' THEN status END AS status, len(chain) AS hops, array_to_string(chain, ' ') AS chain, stop = 'read' AND here <> there AS moved, stop FROM told
      UNION ALL SELECT CAST(id AS BIGINT), final_url, status, hops, chain, moved, stop FROM (VALUES {", ".join(f"({-1 - k}, {_value(f)}, {_value(s)}, {n}, {_value(_CHAINS.get(k, u if n else ''))}, {_value(m)}, {_value(e)})" for k, (u, f, s, n, m, e) in enumerate(SEEDS))}) AS known(id, final_url, status, hops, chain, moved, stop)""",
}
QUERIES = {"redirect_chains": redirect_chains}
