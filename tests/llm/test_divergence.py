"""The source divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from vigil.llm import divergence

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcé", k=RNG.randint(1, 4))) for _ in range(60)]


def prose(n, shift=0):
    return RNG.choice([" ", ", ", "-7-"]).join(RNG.choices(VOCABULARY[shift:], weights=[1 / (k + 1) for k in range(len(VOCABULARY) - shift)], k=n))


def rows(sources):
    out = [("en", f"s{RNG.randrange(sources)}", prose(RNG.randint(0, 30), RNG.randrange(8))) for _ in range(4 * sources)]
    out += [("de", "only", "wort " * 5)] * 12 + [("fr", "a", "un deux"), ("fr", "b", None), (None, None, "x Y " * 9), (None, "s1", "x"), ("en", None, None), ("en", "none", "42")]
    return [*out, *[("", "s2", "X y Ünïcode İ ")] * 10, ("es", "a", "q" * 5000)]


def expected(rows, least=10, top=10):
    docs = [(a or "", b or "", ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in rows]
    df = Counter((a, t) for a, _, own in docs for t in set(own))
    times, groups = defaultdict(Counter), {(a, b) for a, b, _ in docs}
    for a, b, own in docs:
        times[a, b].update(t for t in own if df[a, t] >= least)
        times[a].update(t for t in own if df[a, t] >= least)
    share = lambda g, t, v: 1 + 1000000000 * (times[g][t] + 2) // (sum(times[g].values()) + 2 * v)
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for a, b in groups:
        kept = [t for x, t in df if x == a and df[x, t] >= least]
        v = len(kept)
        p = {t: share((a, b), t, v) for t in kept}
        found = [(sum(f(p[t], share((a, c), t, v)) for t in kept), c) for x, c in groups if x == a and c != b]
        out += [(a, b, "pair", c, value, k + 1) for k, (value, c) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode())))]
        found = [(f(p[t], share(a, t, v)), t) for t in kept if times[a, b][t] and p[t] > share(a, t, v)]
        out += [(a, b, "term", t, value, k + 1) for k, (value, t) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode()))[:top])]
    return sorted(out)


@pytest.mark.parametrize("sources", [5, 140])
def test_audit(spark, monkeypatch, sources):
    given = rows(sources)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in given], "lang string, source string, text string, n int, p int, term string").repartition(3)
    want = expected(given)
    take = lambda df: sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))
    if sources == 5:  # fronts of one term each, and many shards
        for name, value in (("FRONT", 1), ("GROWTH", 2), ("SHARD_ROWS", 20)):
            monkeypatch.setattr(divergence, name, value)
    assert take(divergence.audit(docs)) == want


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, terms = 7 * 10**17, 9 * 10**17, 10**9
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_buckets_grow_with_counts(spark):
    got = [r.b for r in spark.range(1, 5000).withColumnRenamed("id", "n").select(divergence._bucket().alias("b")).collect()]
    assert got == sorted(got) and got[:63] == list(range(1, 64)) and len(set(got)) < 300
