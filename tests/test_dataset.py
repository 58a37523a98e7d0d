"""Ranking over several ranges, even classes, incomplete corrections, and what is saved and read back."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import dataset, evidence, training
from vigil.sources import readers


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_over_many_ranges(spark, monkeypatch, adaptive):
    monkeypatch.setattr(dataset, "ROWS_A_TASK", 50)
    draw = random.Random(3)
    values = [draw.choice([None, 5, 5, 5, draw.randrange(400)]) for _ in range(1000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = dataset.ranked(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert [r.place for r in got] == list(range(1, 1001))
    assert [r.v for r in got] == sorted(values, key=lambda x: (x is not None, x))


def test_even_classes(spark):
    rows = [(k % 40, int(k % 3 == 0)) for k in range(900)] + [(k * 1_000_003, 1) for k in range(30)]
    got = dataset.balanced(spark.createDataFrame(rows, "key long, y int"), "y", "key", 42).collect()
    rank = lambda x: ((x[0] * 7919 + 42) % 1_000_003, x[0])
    most = min(sum(y == c for _, y in rows) for c in (0, 1))
    want = [r for c in (0, 1) for r in sorted((r for r in rows if r[1] == c), key=rank)[:most]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert dataset.balanced(spark.createDataFrame([], "key long, y int"), "y", "key", 42).count() == 0


def test_backfill(spark):
    base = spark.createDataFrame([(1.0, 0, "a")], "f double, is_phishing int, url string")
    fixed = spark.createDataFrame([(2.0, 1, "b"), (None, 1, "c"), (float("nan"), 0, "d"), (3.0, 0, "e")], "f double, is_phishing int, url string")
    assert sorted(r.url for r in dataset.backfilled(base, fixed, ["f"], 3, 2).collect()) == ["a", *"bbb", *"eee"]
    assert dataset.backfilled(base, fixed, ["f"], 3, 3).count() == 1
    assert dataset.backfilled(base, fixed, ["f"], 3, 5).count() == 1
    assert dataset.backfilled(base.withColumn("g", F.lit(1.0)), fixed, ["f", "g"], 3, 1).count() == 1
    assert dataset.backfill_preview(base, fixed, ["f"], 3, 2).first().asDict() == {"given": 4, "safe": 2, "dangerous": 2, "usable": 2, "base": 1, "added": 6, "total": 7}


def test_a_hit_is_not_filled_from_a_probe(spark):
    probe = spark.createDataFrame([("a.com", None, "1.1.1.1"), ("b.com", None, None), ("", 5, "2.2.2.2")], "domain string, age_days long, ip string")
    stored = evidence.storable(probe)
    assert [r.domain for r in stored.collect()] == ["a.com"]
    asked = spark.createDataFrame([(1, "a.com", None), (2, "b.com", None), (3, "a.com", "port")], "id long, domain string, blocked string").withColumn("ts", F.current_timestamp())
    fresh = spark.createDataFrame([(1, 9, "Reg"), (2, 9, "Reg"), (3, 9, "Reg")], "id long, age_days long, registrar string")
    pages = spark.createDataFrame([(1, True), (3, True)], "id long, readable boolean")
    got = {r.id: r for r in evidence.assembled(asked, stored.withColumn("expires_at", F.lit(None).cast("timestamp")), fresh, pages).collect()}
    assert (got[1].from_cache, got[1].age_days, got[1].registrar, got[1].ip, got[1].readable, got[1].failures) == (True, None, None, "1.1.1.1", True, [])
    assert (got[2].from_cache, got[2].age_days, got[2].ip, got[2].readable, got[2].failures) == (False, 9, None, None, ["no page"])
    assert (got[3].from_cache, got[3].age_days, got[3].ip, got[3].readable, got[3].failures) == (None, None, None, None, ["blocked: port"])


def test_saved_and_read_back(spark, tmp_path):
    assert training.load(str(tmp_path / "none")) is None
    readers.write_features(spark.createDataFrame([(1.0, 1, "u")], "f double, is_phishing int, url string"), str(tmp_path / "f"))
    assert readers.read_features(spark, str(tmp_path / "f"), ["f"]).collect() == [(1.0, 1, "u")]
    for _ in range(2):
        readers.append_history(spark.createDataFrame([(1,)], "id long"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
