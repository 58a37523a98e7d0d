"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from vigil.llm import spelling

RNG = random.Random(11)
COMMON = ["language", "fußball", "grammar", "aaaaaaaa", "résumés"]


def edited(word, letters):
    k = RNG.randrange(len(word))
    return RNG.choice([word[:k] + word[k + 1 :], word[:k] + RNG.choice(letters) + word[k:], word[:k] + RNG.choice(letters) + word[k + 1 :]])


def rows():
    out = [(None, "language Language LANGUAGE"), (1, None), (2, ""), (3, "42 ,;"), (4, "kurz kurz"), (5, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3001), (6, "日本 naïvetés×÷ naïvetés×÷")]
    for i in range(7, 60):
        own = RNG.choices(COMMON, k=40) + [edited(RNG.choice(COMMON), "abcdé") for _ in range(12)] * 2
        own += [edited(edited(RNG.choice(COMMON), "abcdé"), "abcdé") for _ in range(6)]
        out.append((i, " ".join([*own, *["chainings"] * 50, *["chaining"] * 4, *["chainin"] * (i % 10 == 0)])))
    return [*out, out[-1]]


def expected(rows, least_letters=7, least_seen=2, ratio=10):
    seen = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_letters:
                seen[run] += 1
    seen = {w: n for w, n in seen.items() if n >= least_seen}
    cut = {w: {w[:k] + w[k + 1 :] for k in range(len(w))} for w in seen}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return a in cut[b] or b in cut[a]

    around = {a: sorted((b for b in seen if abs(len(a) - len(b)) < 2 and near(a, b)), key=lambda b: (-seen[b], b)) for a in seen}
    form = {a: next((b for b in around[a][:1] if seen[b] >= ratio * seen[a]), None) for a in seen}

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return sorted((a, form[a], root(a), seen[a], len(around[a]), seen.get(form[a])) for a in seen)


def test_neighbourhood_is_complete_and_distinct():
    letters = np.frombuffer(b"abc", np.uint8)
    for word in (b"a", b"aa", b"abba", b"cabbb"):
        text = word.decode()
        wanted = {text[:k] + text[k + 1 :] for k in range(len(text))}
        wanted |= {text[:k] + x + text[k + 1 :] for k in range(len(text)) for x in "abc"} | {text[:k] + x + text[k:] for k in range(len(text) + 1) for x in "abc"}
        wanted.discard(text)
        name = lambda w: (int(spelling.Words([w.encode()]).names(0)[0]), int(spelling.Words([w.encode()]).names(1)[0])) if w else None
        own = spelling.Words([b"bbc", word])
        everything = lambda x: np.ones(x.shape, bool)
        got = []
        for parts in ([own.deletions()], own.written_in(letters, False, everything), own.written_in(letters, True, everything)):
            for w, x, y in parts:
                got += [(int(a), int(b)) for a, b in zip(x[w == 1], y[w == 1], strict=True)]
        assert len(got) == len(set(got)) == len(wanted)
        assert {name(w) for w in wanted if w} <= set(got)


def test_variants(spark, monkeypatch):
    given = rows()
    docs = spark.createDataFrame([(*r, "other", 1) for r in given], "doc_id long, text string, word string, n int").repartition(3)
    want = expected(given)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    take = lambda df: sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)
    assert take(spelling.variants(spelling.vocabulary(docs))) == sorted(want, key=key)
    monkeypatch.setattr(spelling, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(spelling, "PIECE", 1000)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    assert take(spelling.variants(spelling.vocabulary(docs))) == sorted(want, key=key)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
    one = spark.createDataFrame([("a", "letters letters letters")], "doc_id string, text string")
    assert [tuple(r) for r in spelling.variants(spelling.vocabulary(one)).collect()] == [("letters", None, "letters", 3, 0, None)]


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(str(k), str(k + 1)) for k in range(12)], "word string, form string")
    assert {r.word: r.root for r in spelling._roots(forms, 12).collect()} == {str(k): "12" for k in range(12)}
