"""No link of a message and no end of a page is left out."""

import duckdb

from vigil.functions import pages as P

BAD = "http://togel-emas88.com"


def test_all_links_of_a_message_are_scored(spark, tmp_path):
    from __spark_entry__ import oracle_sql, queries

    harmless = [" ".join(f"https://www.google.com/a{k}" for k in range(n)) for n in (0, 14, 15, 40, 3000)]
    rows = [(8 * k + 1, 0, "user", f"{text} {BAD}") for k, text in enumerate(harmless)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: (r.risk_score, r.threat_label) for r in queries()["email_scan"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and len(set(got.values())) == 1 and got[1000][1] == "Malicious"
    # the roll-up keeps to the number of links that its SQL names
    rolled = queries()["email_link_rollup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(rolled.columns)} FROM ({oracle_sql()['email_link_rollup']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rolled.collect())


def _agrees(spark, folder, name, pages):
    """The rows of the query and of its SQL over made pages; both the same."""
    from __spark_entry__ import oracle_sql, queries

    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    return {r[0]: r for r in got.collect()}


def test_a_page_is_read_to_its_end(spark, tmp_path):
    filler = "<p>some words &amp; more</p>\n" * 20_000
    pages = [(k, "http://a.com/", f"<title>{'t' * 50 * k}</title>{filler}<b>password judi</b>") for k in range(12)]
    got = _agrees(spark, tmp_path, "page_evidence", pages)
    assert all(got[k].credential_words >= 1 and got[k].gambling_words >= 1 and len(got[k].title) == 50 * k for k in range(12))


def test_scripts_are_read_to_their_end(spark):
    late = "<script>" + "y = 1;\n" * 60_000 + "</script><script>eval(atob('x'))</script>"
    long = ["<script>fromCharCode(" + "12, " * 150_000 + "3)</script>", "<script>'" + r"\x41" * 150_000 + "'</script>"]
    short = ["<script>fromCharCode(" + "1," * 11 + "1)</script>", "<script>fromCharCode(" + "1 , " * 12 + "1)</script>", "<script>" + r"\x41" * 25 + "</script>", "<script>" + r"\x41" * 26 + "</script>"]
    rows = spark.createDataFrame(list(enumerate([late, *short, *long])), "k int, html string")
    got = {r.k: r.scrambled for r in P.with_page_features(rows).select("k", "scrambled").collect()}
    assert got == dict(enumerate([True, False, True, False, True, True, True]))


def test_brands_are_looked_for_to_the_end_of_a_page(spark, tmp_path):
    filler = "<p>some words &amp; more</p>\n" * 20_000
    got = _agrees(spark, tmp_path, "page_site_evidence", [(k, "http://shop.example.com/", filler) for k in range(14)])
    assert got[6].brand == got[13].brand == "paypal" and got[0].brand is None
