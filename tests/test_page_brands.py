import re
import time

from pyspark.sql import functions as F

from vigil.functions import dictionaries as D
from vigil.functions import pages as P
from vigil.plans import urls

TEXTS = ["PayPal, google", "xpaypal paypal9 dana", "danamon bri-bca", "grab.ovo", "9gag ovo9 ovoovo ovo", "bribri bri", "freefire free fire", "", "  ", "_dana_", "édanaé", "shopee shopee"]


def test_brands_of_a_text_are_found_in_one_pass(spark):
    pages = spark.createDataFrame([(k, u, t) for k, t in enumerate(TEXTS) for u in ("https://www.dana.id/x", "https://a.google.com", "http://1.2.3.4/")], "page_id long, url string, html string")
    got = P.with_site_features(pages, urls.suffixes(spark))
    own = {"https://www.dana.id/x": "dana.id", "https://a.google.com": "google.com", "http://1.2.3.4/": ""}
    for r in got.collect():
        named = [b for b, official in D.BRANDS.items() if re.search(f"(?<![a-z0-9]){b}(?![a-z0-9])", TEXTS[r.page_id].lower()) and own[r.url] != official]
        assert r.brand == (named[0] if named else None), r
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<![a-z0-9])") <= 1  # not a pattern for each brand


def test_blanks_are_cut_off_in_linear_time(spark):
    texts = ["", " ", " a ", "a  \n b ", "\x1c\x85a　", "\n\n", "a", "a" + " " * 60_000 + "b ", " " * 60_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    began = time.time()
    assert {r.k: r.s for r in rows.select("k", P.stripped(F.col("t")).alias("s")).collect()} == {k: t.strip() for k, t in enumerate(texts)}
    assert time.time() - began < 4
