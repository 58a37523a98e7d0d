"""Many words, cut entities and repeated addresses: the query and its SQL on made tables."""

import re

import duckdb
from pyspark.sql import functions as F

from vigil.operators import names


def test_more_words_than_an_automaton_holds(spark):
    words = spark.range(250_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    texts = ["xw249999w7", "w249999", "w249999", None, "", "é" * 40 + "w12", "w" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    known = {f"w{k}" for k in range(250_000)}
    got = {r.id: (r.n_words, r.n_hits) for r in names.contained(rows, "body", words).collect()}
    within = lambda t: [t[a:b] for a in range(len(t)) for b in range(a + 1, len(t) + 1) if t[a:b] in known]
    assert got == {k: (len(set(within(t or ""))), len(within(t or ""))) for k, t in enumerate(texts)}


def test_long_words_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(names, "PIECE", 7)
    long = "ab" * 40
    words = spark.createDataFrame([(w,) for w in (long, long[:70], "ba", "𝕏y")], "word string")
    rows = spark.createDataFrame([(1, long + "x" + long[:71] + "𝕏y"), (2, long[:69])], "id long, body string")
    got = {r.id: (r.n_words, r.n_hits) for r in names.contained(rows, "body", words).collect()}
    a, b = (r.body for r in rows.orderBy("id").collect())
    assert got == {k: (sum(w in t for w in (long, long[:70], "ba", "𝕏y")), sum(len(re.findall(f"(?={w})", t)) for w in (long, long[:70], "ba", "𝕏y"))) for k, t in ((1, a), (2, b))}


def _agree(spark, tmp_path, name, pages, columns):
    from __spark_entry__ import oracle_sql, queries

    spark.createDataFrame(pages, columns).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_title_cut_inside_an_entity(spark, tmp_path):
    titles = ["a &amp;&amp", "b &amp b&amp;amp", "c &am", "d & &", "e &amp-f &ampx; g", "h &amp&amp;", "i &quot;73&quot", "j &lt;b&gt; &#39;k&#x27"]
    _agree(spark, tmp_path, "page_evidence", [(k, "http://a.com/", f"<title>{t}</title>") for k, t in enumerate(titles)], "page_id long, url string, html string")


def test_pages_with_one_address(spark, tmp_path):
    urls = ["http://a.one.org/", "http://b.two.org/", "http://a.one.org/", "http://c.three.org/", "http://b.two.org/", "http://a.one.org/", "http://d.four.org/"]
    _agree(spark, tmp_path, "redirect_chains", [(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
