"""The address guard over page addresses and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import url as U
from vigil.operators import guard as G
from vigil.plans import urls

# addresses that SQL below works out by itself
SEEDS = ["http://127.0.0.1/", "http://169.254.169.254/latest", "http://10.0.0.5:8080", "http://192.168.1.1", "http://172.20.0.1", "http://172.32.0.1", "http://8.8.8.8", "https://1.1.1.1:8443/x", "http://8.8.8.8:22", "file:///etc/passwd", "gopher://8.8.8.8", "ftp://8.8.8.8", "http://localhost:5000", "http://0.0.0.0", "http://255.255.255.255", "http://300.1.1.1", "https://example.com:9999", "http://100.100.1.1", "http://224.0.0.1"]


# Addresses with the answer worked out by hand.
ANSWERS = {
    "http://[::1]/": "not public", "http://[::ffff:127.0.0.1]/": "not public", "http://[fe80::1]:8080/": "not public", "http://[fc00::7]/": "not public", "http://[2001:db8::1]/": "not public", "http://[2002:7f00:1::]/": "not public",
    "http://[2606:4700:4700::1111]/": None, "http://[2606:4700:4700::1111]:22/": "port", "http://[2606::4700::1111]/": "not public", "http://[2606:4700:4700::1111%25eth0]/": "not public",
    "http://2130706433/": "not public", "http://0x7f.0.0.1/": "not public", "http://0177.0.0.1/": "not public", "http://127.1/": "not public", "http://0x7f000001/": "not public", "http://010.8.8.8/": None, "http://08.8.8.8/": "not public",
    "http://134744072/": None, "http://8.8.2056/": None, "http://1.2.3.4.5/": "not public", "http://localhost./": "not public", "http://a.localhost/": "not public", "http://example.com:abc/": "port", "http://example.com:8080/": None, "http://example.com.:80/": None,
    "http://127.0.0.1\t/": "not public", "http://127.0.0\t.1/": "not public", "http://127.0.0.1\n/": "not public", "http://１２７.0.0.1/": "not public", "http://127。0。0。1/": "not public", "http://127．0｡0.1/": "not public", "http://ⓛocalhost/": "not public", "http://LOCALHOST../": "not public",
    "http://127.0.0.1../": "not public", "http://127.0.0.1%2f/": "host", "http:\\\\127.0.0.1/": "host", "http://example.com\\@127.0.0.1/": "host", "http://127.0.0.1\\@example.com/": "host", "http://local\u00adhost/": "host", "http://a..b/": "host", "http://٣.com/": "host",
    "http://münchen.de/": None, "http://ｅxample.com/": None, "http://[::ffff:8.8.8.8]/": None, "http://[2606:4700::8.8.8.8]/": None, "http://[1:2:3:4:5:6:7]/": "not public", "http://[::1%25lo]/": "not public",
}


# Names with their answers, the reason and the address to fetch from, by hand.
RESOLVED: dict[str, tuple[list[str | None], str | None, str | None]] = {
    "good.test": (["8.8.8.8", "2606:4700::1"], None, "8.8.8.8"), "Mixed.Test.": (["8.8.4.4", "8.8.8.8"], None, "8.8.4.4"), "hidden.test": (["8.8.8.8", "1.1.1.1", "9.9.9.9", "192.168.0.7"], "not public", None), "six.test": (["2606:4700::1", "fd00::1"], "not public", None),
    "mapped.test": (["::ffff:10.0.0.1"], "not public", None), "edge.test": (["11.0.0.0", "9.255.255.255", "172.32.0.0", "172.15.255.255", "192.167.255.255", "223.255.255.255"], None, "11.0.0.0"), "edges.test": (["100.128.0.0", "100.127.255.255"], "not public", None),
    "last.test": (["255.255.255.255"], "not public", None), "odd.test": (["8.8.8.8", "nonsense"], "not public", None), "null.test": ([None], "not public", None), "nobody.test": ([], "no address", None), "8.8.8.8": ([], None, "8.8.8.8"), "localhost": (["8.8.8.8"], "not public", None),
    "meta.test": (["169.254.169.254"], "not public", None), "zone.test": (["fe80::1%eth0"], "not public", None), "high.test": (["1fff:ffff::1", "2000::1"], "not public", None), "low.test": (["2000::", "3ffe:ffff:ffff:ffff:ffff:ffff:ffff:ffff"], None, "2000::"),
}


def ssrf_literal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(-1000 - k, s) for k, s in enumerate([*SEEDS, *ANSWERS])], "id long, url string")
    rows = U.with_host(urls.inputs(spark, sf_dir).unionByName(seeds), urls.suffixes(spark))
    return rows.select("id", G.blocked(rows).alias("blocked"))


def ssrf_resolved_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers for the host of each page, none for some; the last may be an inner one."""
    seeds = spark.createDataFrame([(-1 - k, f"http://{h}/") for k, h in enumerate(RESOLVED)], "id long, url string")
    known = spark.createDataFrame([(h, k, a) for h, (given, _, _) in RESOLVED.items() for k, a in enumerate(given)], "host string, at int, address string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    rows = U.with_host(pages.unionByName(seeds), urls.suffixes(spark)).select("id", "url", "text", "authority", "host")
    n = F.length("host")
    last = F.when(n % 5 == 0, "10.0.0.1").when(n % 5 == 1, "::ffff:127.0.0.1").when(n % 5 == 2, "2001:DB8::1").otherwise("2606:4700::1111")
    address = F.when(F.col("at") == 0, F.concat_ws(".", n * 7 % 223 + 1, n * 13 % 256, F.lit("0.1"))).when(F.col("at") == 1, F.concat(F.lit("2a00::"), n)).otherwise(last)
    made = rows.where("id >= 0").select("host").distinct().where(n % 7 > 0).select("host", F.explode(F.array(*map(F.lit, range(3)))).alias("at")).select("host", "at", address.alias("address"))
    return G.resolved(rows, made.unionByName(known)).select("id", "blocked", "address")


_MORE = " UNION ALL SELECT CAST(id AS BIGINT), url FROM (VALUES " + ", ".join(f"({-1000 - k}, '{s}')" for k, s in enumerate(SEEDS)) + ") AS more(id, url)"
_INNER = " OR ".join(f"ip BETWEEN {G.number(a)} AND {G.number(b)}" for a, b in G.NOT_PUBLIC)
ORACLE = {
    "ssrf_literal_guard": rf"""WITH {urls.HOSTS_SQL.replace(urls.SOURCE_SQL, urls.SOURCE_SQL + _MORE)},
      n AS (SELECT *, lower(regexp_extract(text, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, TRY_CAST(regexp_extract(authority, ':([0-9]+)$', 1) AS INTEGER) AS given, list_transform(string_split(host, '.'), lambda x: TRY_CAST(x AS BIGINT)) AS q FROM hosts),
      m AS (SELECT *, coalesce(given, CASE WHEN scheme = 'https' THEN 443 ELSE 80 END) AS port, CASE WHEN is_ip AND greatest(q[1], q[2], q[3], q[4]) <= 255 THEN ((q[1] * 256 + q[2]) * 256 + q[3]) * 256 + q[4] END AS ip FROM n)
      SELECT id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN port NOT IN ({", ".join(map(str, G.PORTS))}) THEN 'port' WHEN coalesce({_INNER}, FALSE) OR host = 'localhost' OR (is_ip AND ip IS NULL) THEN 'not public' WHEN NOT is_ip AND NOT regexp_matches(host, '^[a-z0-9_\-\p{{L}}\p{{M}}]+(\.[a-z0-9_\-\p{{L}}\p{{M}}]+)*$') THEN 'host' END AS blocked FROM m
      UNION ALL SELECT CAST(id AS BIGINT), blocked FROM (VALUES {", ".join(f"({-1000 - len(SEEDS) - k}, {repr(v) if v else 'NULL'})" for k, v in enumerate(ANSWERS.values()))}) AS known(id, blocked)""",
    "ssrf_resolved_guard": rf"""WITH {urls.HOSTS_SQL.replace(urls.SOURCE_SQL, "SELECT page_id AS id, url FROM pages")},
      a AS (SELECT id, length(host) AS n, (length(host) * 7 % 223 + 1) * 16777216 + length(host) * 13 % 256 * 65536 + 1 AS ip, concat_ws('.', length(host) * 7 % 223 + 1, length(host) * 13 % 256, '0.1') AS first FROM hosts),
      b AS (SELECT id, first, CASE WHEN n % 7 = 0 THEN 'no address' WHEN n % 5 < 3 OR {_INNER} THEN 'not public' END AS blocked FROM a)
      SELECT id, blocked, CASE WHEN blocked IS NULL THEN first END AS address FROM b
      UNION ALL SELECT CAST(id AS BIGINT), blocked, address FROM (VALUES {", ".join(f"({-1 - k}, {repr(b) if b else 'NULL'}, {repr(c) if c else 'NULL'})" for k, (_, b, c) in enumerate(RESOLVED.values()))}) AS known(id, blocked, address)""",
}
QUERIES = {f.__name__: f for f in (ssrf_literal_guard, ssrf_resolved_guard)}
