"""Near names and contained words against plain comparisons; redirects and resolved hosts on odd rows."""

import random

from pyspark.sql import functions as F

from vigil.operators import guard, names, redirects


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(90)] + [None, "", "a" * 500]
    known = ["".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(40)] + [None, ""]
    texts, table = spark.createDataFrame([(w,) for w in words], "text string"), spark.createDataFrame([(w,) for w in known], "name string")
    for most in (1, 2):
        got = {(r.text, r.name): r.distance for r in names.near(texts, table, most).collect()}
        assert got == {(a, b): distance(a, b) for a in set(words) - {None} for b in set(known) - {None} if distance(a, b) <= most}
    assert names.nearest(texts, table).count() == len(words)
    assert names.nearest(texts, table.limit(0)).where("name is not null").count() == 0


def test_contained_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)] + ["", None, "日本"]
    texts = ["".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(50)] + [None, "", "x日本日本"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    known = {w for w in words if w}
    got = {r.id: (r.n_words, r.n_hits) for r in names.contained(rows, "body", spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {k: (sum(w in (t or "") for w in known), sum((t or "").startswith(w, i) for w in known for i in range(len(t or "")))) for k, t in enumerate(texts)}
    none = names.contained(rows, "body", spark.createDataFrame([], "word string"))
    assert {(r.n_words, r.n_hits) for r in none.collect()} == {(0, 0)}


def test_binary_search_in_blocks(spark):
    blocks = guard.Blocks([("10.0.0.5", "10.0.0.9"), ("10.0.0.8", "10.0.0.12"), ("9.0.0.0", "9.0.0.0"), ("2001:db8::", "2001:db8::ff")])
    assert len(blocks.bounds) == 3
    given = {"10.0.0.4": False, "10.0.0.5": True, "10.0.0.12": True, "10.0.0.13": False, "9.0.0.0": True, "9.0.0.1": False, "2001:db8::ff": True, "2001:db8::1:0": False, "::ffff:10.0.0.9": True, "nonsense": True, "1:2:3": True, "::": False, "2001:db8::1::2": True}
    rows = spark.createDataFrame([(k,) for k in given], "a string").select("a", blocks.holds(guard.place(F.col("a"))).alias("held"))
    assert {r.a: r.held for r in rows.collect()} == given


def test_redirects_without_rows(spark):
    from vigil.plans import urls

    known = urls.suffixes(spark)
    none = spark.createDataFrame([], "url string, status int, location string")
    asked = spark.createDataFrame([("http://a.com", 1), ("http://a.com", 2), (None, 3)], "url string, k int")
    got = {r.k: (r.stop, r.hops, r.moved) for r in redirects.follow(asked, none, known).collect()}
    assert got == {1: ("no answer", 0, False), 2: ("no answer", 0, False), 3: ("blocked: scheme", 0, False)}
    assert redirects.follow(asked.limit(0), none, known).count() == 0
