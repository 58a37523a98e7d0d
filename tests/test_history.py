"""The cache with probes that fail, and the chains and running sums below it, against plain folds."""

import random

from pyspark.sql import functions as F

from vigil.operators import history, prefix


def test_failed_probes_are_not_stored(spark):
    rows = [(1, "a", 1, None), (2, "a", 2, 5), (3, "a", 3, None), (4, "a", 9, None), (5, "a", 10, 5), (6, "a", 12, 5), (7, "b", 1, 5), (8, "b", 2, None)]
    requests = spark.createDataFrame(rows, "event_id long, domain string, day int, age int").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    miss = lambda df: [r.event_id for r in df.where("miss").orderBy("event_id").collect()]
    assert miss(history.cache_misses(requests, 7, F.col("age").isNotNull())) == [1, 2, 5, 7]
    assert miss(history.cache_misses(requests, 7)) == [1, 4, 7]


def test_cache_against_a_fold(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None] + list(range(60)) * 3), rng.random() < 0.6) for k in range(900)]
    requests = spark.createDataFrame(rows, "event_id long, domain string, day int, fine boolean").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    until, want = {}, set()
    for k, domain, day, fine in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if domain is None or day is None:
            want.add(k)
        elif until.get(domain, -1) < day:
            want.add(k)
            if fine:
                until[domain] = day + 7
    assert {r.event_id for r in history.cache_misses(requests, 7, F.col("fine")).where("miss").collect()} == want
    assert history.cache_misses(requests, 7, F.col("fine")).count() == len(rows) and history.cache_misses(requests.limit(0), 7).count() == 0


def test_following_and_running_in_many_ranges(spark):
    rng = random.Random(6)
    points = sorted({(rng.choice("ab"), rng.randrange(500)) for _ in range(120)})
    asked = [(rng.choice("abc"), rng.randrange(-5, 510), k) for k in range(300)]
    given, questions = spark.createDataFrame(points, "g string, p int"), spark.createDataFrame(asked, "g string, at int, k int")
    for size in (7, 1000):
        got = {r.k: r.next for r in prefix.following(given, questions, ["g"], "p", "at", size).collect()}
        assert got == {k: min((p for h, p in points if h == g and p > at), default=None) for g, at, k in asked}
        sums = {(r.g, r.p): (r.upto_p2, r.all_p2) for r in prefix.running(given.withColumn("p2", F.col("p") * 2), ["g"], "p", ["p2"], size).collect()}
        assert sums == {(g, p): (sum(2 * x for h, x in points if h == g and x <= p), sum(2 * x for h, x in points if h == g)) for g, p in points}
    assert prefix.running(given.withColumn("n", F.lit(1)).limit(0), [], "p", ["n"]).count() == 0


def test_classes_in_even_folds(spark):
    from vigil.operators import training

    rows = spark.createDataFrame([(k, k % 7 == 0, f"key{k}") for k in range(1003)] + [(2000, None, "last")], "id int, y boolean, key string")
    got = training.stratified(rows, "y", "key").groupBy("y", "__fold").count().collect()
    for y in (True, False):
        sizes = [r["count"] for r in got if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in got) == 1004
