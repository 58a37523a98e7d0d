"""Every query against its SQL in DuckDB on the same tables; table-driven checks of the scoring semantics."""

import io
import math
import zipfile
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vigil.functions import files, url
from vigil.operators import history
from vigil.plans import urls as plans_urls
from vigil.plans.catalogue import ORACLE, QUERIES
from vigil.sources import readers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    mine = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in rows), key=str)
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def scored(spark, urls):
    from vigil.operators import rules

    rows = url.with_features(url.with_host(spark.createDataFrame(list(enumerate(urls)), "id long, url string"), plans_urls.suffixes(spark)))
    got = rules.fused(rows, F.lit(0.0), spark.createDataFrame([], "registered string")).select("id", "risk_score", "threat_label").collect()
    return {urls[r.id]: (r.risk_score, r.threat_label) for r in got}


def test_verdicts(spark):
    safe = ["https://www.google.com", "https://github.com/a/b", "wikipedia.org"]
    bad = ["togel-emas88.com", "paypal-login.xyz", "http://10.1.2.3/a", "spotify.com.am", "gooogle.com", "https://xn--a-b.com"]
    got = scored(spark, safe + bad)
    assert all(got[u][1] == "Safe" for u in safe) and all(got[u][1] == "Malicious" for u in bad)
    assert all(0 <= s <= 1 for s, _ in got.values())


def test_typo_forms_score_alike(spark):
    forms = ["https://paypal-login.xyz", "https:paypal-login.xyz", " paypal-login.xyz ", "paypal-login .xyz"]
    assert len(set(scored(spark, forms).values())) == 1


def test_suffix_table(spark):
    want = {"http://a.co.th": ("a", "co.th"), "http://x.com.vn": ("x", "com.vn"), "x.nu": ("x", "nu"), "shop.any.ck": ("shop", "any.ck"), "any.ck": ("", "any.ck"), "www.ck": ("www", "ck"), "deep.www.ck": ("www", "ck"), "x.y.kawasaki.jp": ("x", "y.kawasaki.jp"), "www.city.kawasaki.jp": ("city", "kawasaki.jp"), "z.a.b.c.d.com": ("z", "a.b.c.d.com"), "b.c.d.com": ("d", "com"), "my.pages.dev": ("pages", "dev"), "x.unknownzone": ("unknownzone", ""), "1.2.3.4": ("1.2.3.4", ""), "w.x.one.two.three.four.five.org": ("w", "x.one.two.three.four.five.org"), "one.two.three.four.five.org": ("five", "org"), "http://a.b.co.th/login": ("b", "co.th"), "http://shop.com.vn": ("shop", "com.vn")}
    rows = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: (r.domain, r.suffix) for r in url.with_host(rows, plans_urls.suffixes(spark)).collect()} == want


def test_suffixes_by_a_table_of_any_length(spark):
    """Ten thousand rules, the longest of nine labels, within an array; no rules at all."""
    rules = [f"z{k}.zone" for k in range(10_000)] + ["a.b.c.d.e.f.g.h.zone"]
    known = url.Suffixes(spark.createDataFrame([(r,) for r in rules], "rule string"))
    hosts = ["x.z77.zone", "x.y.zone", "v.w.a.b.c.d.e.f.g.h.zone", ""]
    rows = spark.createDataFrame([(hosts,)], "hosts array<string>")
    assert rows.select(F.transform("hosts", known.registered)).first()[0] == ["x.z77.zone", "", "w.a.b.c.d.e.f.g.h.zone", ""]
    assert rows.select(F.transform("hosts", url.Suffixes(spark.createDataFrame([], "rule string")).registered)).first()[0] == [""] * 4


@pytest.mark.parametrize("name", ["url_rules_fused", "evidence_assembled", "page_evidence", "email_link_rollup"])
def test_plans_compile(spark, sf, name):
    """With the fallback off, generated code that does not compile is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES[name](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_empty_and_null_urls(spark):
    got = scored(spark, ["", "!!!", "://", "http://", "a" * 5000])
    assert len(got) == 5
    assert url.with_features(url.with_host(spark.createDataFrame([(1, None)], "id long, url string"), plans_urls.suffixes(spark))).count() == 1


def test_limiter_is_greedy(spark):
    times = [0, 10, 20, 30, 61, 62, 71, 200]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.admitted for r in history.admitted(rows, 3, 60).orderBy("event_id").collect()]
    seen, want = deque(), []
    for t in times:
        while seen and seen[0] < t - 60:
            seen.popleft()
        want.append(len(seen) < 3)
        if want[-1]:
            seen.append(t)
    assert got == want


def test_ownerless_rows_are_hidden(spark):
    rows = spark.createDataFrame([(1, None, "Safe"), (2, 5, "Safe")], "id long, user_id long, threat_label string")
    assert history.owned(rows, F.lit(None)).count() == 0 and history.label_counts(rows).count() == 1


def archive(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def test_archives():
    got = files.zip_listing(archive(["a.txt", "run.exe", "in.zip", "word/vbaProject.bin"]))
    assert (got["entries"], got["macro"], got["inner_runnable"], got["example"], got["nested"], got["damaged"]) == (4, True, 1, "run.exe", 1, False)
    assert files.zip_listing(b"PK\x03\x04 broken")["damaged"]
    assert files.byte_entropy(b"") == 0.0 and files.byte_entropy(bytes(range(256))) == 8.0


def test_readers(spark, tmp_path):
    (tmp_path / "ranked.csv").write_text("1,google.com\n2,example.org\n")
    (tmp_path / "list.txt").write_text(" A.com \n\nb.com\n")
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "none.bin").write_bytes(b"")
    (tmp_path / "up" / "one.bin").write_bytes(b"12345")
    assert readers.ranked_domains(spark, str(tmp_path / "ranked.csv")).count() == 2
    assert {r.domain for r in readers.blocklist(spark, str(tmp_path / "list.txt")).collect()} == {"a.com", "b.com"}
    assert readers.optional_lines(spark, str(tmp_path / "missing.txt")).count() == 0
    # Spark's file sources leave out files without bytes
    assert [(r.length, r.reject_reason) for r in readers.uploads(spark, str(tmp_path / "up"), 4).collect()] == [(5, "too large")]
    assert [(r.length, r.reject_reason) for r in readers.uploads(spark, str(tmp_path / "up")).collect()] == [(5, None)]


def test_mail_parts_survive_parsing(spark, sf):
    """Raw text built from parts parses back into them."""
    from vigil.plans import mails

    got = {r.id: r for r in mails.email_parse_mime(spark, sf).collect()}
    ascii_only = {r.id: r for r in mails.inputs(spark, sf).collect() if r.body.isascii()}
    assert ascii_only
    for k, r in ascii_only.items():
        g = got[k]
        assert (g.has_header, g.from_name, g.from_addr, g.reply_to, g.return_path, g.subject, g.body) == (r.has_header, r.from_name, r.from_addr, r.reply_to, r.return_path, r.subject, r.body)


def test_mime(spark):
    from vigil.functions import mail

    both = 'From: =?utf-8?q?Bank?= <A@B.com>\nReply-To: x@y.z, q@r.s\nSubject: s\nContent-Type: multipart/mixed; boundary=K\n\n--K\nContent-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: quoted-printable\n\ncaf=E9\n--K\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="a.pdf.exe"\n\nxx\n--K--\n'
    got = mail.parts_of(both)
    assert got[2:4] == ("a@b.com", "x@y.z") and got[6].strip() == "café" and got[7] == ["a.pdf.exe"]
    assert mail.parts_of("just text") == (False, "", "", "", "", "", "just text", [])
    rows = spark.createDataFrame([(1, None), (2, ""), (3, both), (4, "Subject: x\n\n\udc80".encode("utf-8", "replace").decode()), (5, "To: a\nContent-Type: text/plain; charset=nonsense\n\nbody")], "id long, raw string")
    assert [(r.id, r.has_header, r.body.strip()) for r in mail.parsed(rows).orderBy("id").collect()] == [(1, False, ""), (2, False, ""), (3, True, "café"), (4, True, "?"), (5, True, "body")]


def test_mail_verdicts(spark):
    from vigil.operators import mail

    texts = {
        1: 'From: "Bank BRI" <bri.check@gmail.com>\nSubject: SEGERA diblokir\n\nkirim kata sandi http://bri-x.tk/login',
        2: "From: Lecturer <l@campus.ac.id>\nSubject: schedule\n\nSee you on Monday.",
        3: "Look at https://slot-gacor-maxwin.com now",
        4: "Files attached: run.exe",
    }
    rows = spark.createDataFrame([*texts.items(), (5, None), (6, "x" * 1_000_001)], "id long, raw string")
    got = {r.id: (r.threat_label, [x.title for x in r.explanations]) for r in mail.scan(rows, spark.createDataFrame([], "registered string"), plans_urls.suffixes(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "Malicious", 2: "Safe", 3: "Malicious", 4: "Malicious"}
    assert got[2][1] == ["nothing_found"] and got[3][1] == ["bad_link", "no_headers"]


def test_links_resolve_like_the_standard_library(spark):
    from urllib.parse import urljoin

    from vigil.functions import links

    bases = ["http://a.example.com/b/c/d.html?q=1", "https://a.example.com", "http://a.example.com/x/"]
    hrefs = ["g", "./g", "../g", "../../g", "../../../g", "/g/../h", "g/", "?y=1", "#s", "g?y/../z", "//x.a.example.com/p", "http://a.example.com/z", "..", ".", "a/./b"]
    rows = [(k, b, f"<a href='{h}'>x</a>", h) for k, (b, h) in enumerate((b, h) for b in bases for h in hrefs)]
    got = {r.id: list(r.links) for r in links.with_inner_links(spark.createDataFrame(rows, "id long, url string, html string, h string")).collect()}
    for k, b, _, h in rows:
        assert got[k] == [urljoin(b, h)], (b, h)
    odd = [(1, None, "<a href='/x'>"), (2, "http://a.b", None), (3, "http://a.b", "<a href='http://c.d/e'>x</a><a href='mailto:x@y'>m</a>")]
    assert [list(r.links) for r in links.with_inner_links(spark.createDataFrame(odd, "id long, url string, html string")).collect()] == [[], [], []]


def test_vector(spark):
    from vigil.functions import vector

    assert len(vector.names()) == 47
    row = vector.with_vector(spark.createDataFrame([(1,)], "id long")).select(*vector.names()).first().asDict()
    assert row["d_age_days"] == row["d_certificate_days"] == -1 and sum(row.values()) == -2


def test_training(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from vigil.operators import training

    rows = spark.range(600).select(F.col("id"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 != 0, F.col("id") % 5).alias("b"), F.when(F.col("id") % 97 != 0, (F.col("id") % 7 > 3).cast("int")).alias("y"), F.concat(F.lit("u"), "id").alias("url"))
    got = training.best_candidate(rows, ["a", "b"], "id", "y", training.learners(5, 2))
    assert all(r.accuracy == 1.0 for r in got.metrics.collect())
    assert [r.feature for r in training.importances(got).collect()][0] == "a"
    got.save(str(tmp_path / "model"))
    assert PipelineModel.load(str(tmp_path / "model")).transform(rows.na.fill(-1)).where("prediction <> y").where("y >= 0").count() == 0
    known = rows.where("y is not null")
    assert training.out_of_fold(rows, ["a", "b"], "id", "y", training.evidence_learner(3, 2)).count() == known.count()
    verdict = training.leakage_verdict(known, ["a", "b"], "url", "id").first()
    assert verdict.leaks and verdict.shallow_flagged and verdict.strong_columns == 1 and verdict.duplicates == 0


def test_site_features(spark):
    from vigil.functions import pages

    rows = [
        (1, "https://shop.a.co.id/x", "<form action='https://pay.a.co.id/y'></form><form method=post action=\"http://u@evil.xyz:80/z\">PayPal</form>"),
        (2, "https://www.paypal.com", "<form action='/local'>PayPal and paypals</form>"),
        (3, "http://10.0.0.1/", "<!-- <form action='http://b.com'> --><script>netflix</script> xgrabx <form action=http://10.0.0.2/a>"),
        (4, None, None),
    ]
    got = {r.id: (r.foreign_target, r.foreign_form, r.brand) for r in pages.with_site_features(spark.createDataFrame(rows, "id long, url string, html string"), plans_urls.suffixes(spark)).collect()}
    assert got == {1: ("evil.xyz", True, "paypal"), 2: (None, False, None), 3: (None, False, None), 4: (None, False, None)}


def test_scripts_and_entities(spark):
    from vigil.functions import pages

    rows = [(1, "<title> A &amp; B </title><p>eval(atob('x'))</p>"), (2, "<!-- <script>eval(atob('x'))</script> -->"), (3, "<script>// <!--\neval(atob('x'))\n//--></script>"), (4, "<p>" + "x" * 200_001 + " password</p>")]
    got = {r.id: r for r in pages.with_page_features(spark.createDataFrame(rows, "id long, html string")).collect()}
    assert [got[k].scrambled for k in (1, 2, 3, 4)] == [False, False, True, False]
    assert got[1].title == "A & B" and got[4].credential_words == 0


def test_zip_names_and_text_ends(spark):
    import io
    import zipfile

    from vigil.functions import files

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for name in ("exe", "dir/" + "n" * 100 + ".scr", "in.tgz", "in.gz", "readme"):
            z.writestr(name, "x")
    got = files.zip_listing(made.getvalue())
    assert (got["entries"], got["inner_runnable"], got["example"], got["nested"], got["damaged"]) == (5, 2, "exe", 1, False)
    assert files.zip_listing(b"PK\x03\x04 nothing")["damaged"]
    rows = spark.createDataFrame([(1, "a", b"abc\x85"), (2, "a", b"abc\n"), (3, "a", b"abc\n\x00")], "id long, name string, content binary")
    assert {r.id: r.kind for r in files.with_file_features(rows).collect()} == {1: "unknown", 2: "text", 3: "unknown"}


def test_notes_beside_rules(spark):
    from vigil.operators import rules as R

    rule = "array(named_struct('name', 'port', 'reason', 'x', 'weight', 0.4D, 'ord', 0))"
    rows = spark.sql(f"""SELECT 1 AS id, slice({rule}, 1, 0) AS rules, 0.0D AS rule_score, false AS allowlisted, 0.1D AS ml, 0.7D AS deep, array('whois') AS failed, 'empty' AS kind
        UNION ALL SELECT 2, slice({rule}, 1, 0), 0.0D, true, 0.6D, 0.59D, slice(array('x'), 1, 0), 'pdf' UNION ALL SELECT 3, {rule}, 0.4D, true, 0.9D, null, null, 'pdf' UNION ALL SELECT 4, slice({rule}, 1, 0), 0.0D, true, 0.2D, null, null, 'zip'""")
    titles = lambda notes: {r.id: [x.title for x in r.n] for r in rows.select("id", notes.alias("n")).collect()}
    assert titles(R.url_notes(F.col("ml"), F.col("deep"), F.col("failed"))) == {1: ["evidence_model", "nothing_found", "failed_checks"], 2: ["popular", "unusual_name"], 3: ["popular_but_flagged"], 4: ["popular"]}
    assert titles(R.file_notes()) == {1: ["empty_file"], 2: ["clean_file"], 3: [], 4: ["clean_file"]}
