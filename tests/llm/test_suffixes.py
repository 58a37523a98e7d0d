"""Removal of repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import suffixes

RNG = random.Random(17)


def letters(n, alphabet="abcdefghijklmnopqrstuvwxyz é日"):
    return "".join(RNG.choices(alphabet, k=n))


def some_texts():
    passage, other, low = letters(1500), letters(420), letters(3000, "ab")
    out = [None, "", "short", passage, passage, passage[:399], passage[3:403], "x" * 399, "x" * 400, "y" * 401, "y" * 3000, "ab" * 700, "ab" * 199 + "ab", "z" * 398 + "q"]
    out += [letters(RNG.randint(0, 300)) + other + letters(RNG.randint(0, 300)) for _ in range(9)]  # at different places, with different neighbours
    out += [letters(50) + passage[a : a + RNG.randint(380, 800)] + letters(60) for a in range(0, 900, 60)]
    out += [passage[:700] + "!" + passage[700:], passage[:350] + "?" + passage[351:], passage + letters(10) + passage]
    out += [low, low[100:1200] + letters(20, "ab"), low[:900] + low[200:1500], letters(2500, "ab")]
    out += [letters(700) for _ in range(6)]
    return [*out, letters(5000) + out[20] + letters(3000)]


def expected(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 400] for d in data for k in range(len(d) - 399))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = True
        out.append((bytes(b for b, g in zip(d, gone, strict=False) if not g), len(d), int(gone.sum()), int(np.sum(gone[1:] < gone[:-1]))))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_dedup(spark, monkeypatch, batches):
    monkeypatch.setattr("vigil.llm.common.groups_for", lambda *_: 7)
    texts = some_texts()
    docs = spark.createDataFrame([(k, t, "en", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, grp int").repartition(3)
    want = expected(texts)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.dedup(docs, batches).collect()}
    assert got == dict(enumerate(want))
    assert sum(r[2] for r in want) > 10_000


def test_rows_without_an_id_and_repeated_rows(spark):
    text = letters(900)
    docs = spark.createDataFrame([(None, text), (1, text[:450]), (1, text[:450]), (2, letters(800))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.dedup(docs).collect())
    n = len(text[:450].encode())
    assert got[0][2] == n and got[1] == got[2] == (1, n, n, 1) and got[3][2:] == (0, 0)
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_runs_hold_every_window_once_and_sample_by_content():
    texts = [letters(n) for n in (0, 399, 400, 401, 3000)] + ["a" * 900, "ab" * 500]
    for piece, text, at in suffixes.pieces(pa.array(texts)):
        data = [t.encode() for t in texts[text:]]
        first = np.cumsum([0] + [len(d) for d in data])
        windows = suffixes.singles(piece.first, piece.last)
        assert windows.tolist() == [f + k for f, d in zip(first, data, strict=False) for k in range(len(d) - 399)]
        assert (piece.place >= piece.last).all() and (piece.place < piece.first + suffixes.PICKS).all()
        by_window = {}
        for w, p in zip(windows.tolist(), np.repeat(piece.place, piece.last - piece.first + 1).tolist(), strict=True):
            assert by_window.setdefault(bytes(piece.data[w : w + 400]), p - w) == p - w
        a, b, core = piece.stretches(np.arange(len(piece.first)))
        assert suffixes.singles(a, b)[np.argsort(suffixes.singles(a, b))].tolist() == windows.tolist()
        assert (core >= b).all() and (core + suffixes.WINDOW - suffixes.FINE + 1 <= a + suffixes.WINDOW).all()


def test_long_documents_in_pieces(monkeypatch):
    text = letters(9000)
    monkeypatch.setattr(suffixes, "LONG", 1000)
    column = pa.array(["tiny", text, "x" * 600])
    found = [(at + w) for piece, _, at in suffixes.pieces(column) for w in suffixes.singles(piece.first, piece.last).tolist()]
    n = len(text.encode())
    assert sorted(found) == [4 + k for k in range(n - 399)] + [4 + n + k for k in range(201)]


def test_names_are_of_content():
    data = np.frombuffer((letters(700) * 2).encode(), np.uint8)
    piece = suffixes.Piece(data, np.array([0, len(data)]))
    half = len(data) // 2
    start = np.arange(0, half - 50)
    one, two = piece.names(start, start + 50), piece.names(start + half, start + half + 50)
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
    assert len(set(zip(one[0].tolist(), one[1].tolist(), strict=True))) == len({bytes(data[k : k + 50]) for k in start})


def test_levels_grow_geometrically(spark):
    family = suffixes.Family()
    for k in range(5):
        rows = spark.range(k * 100, k * 100 + 100).selectExpr("id as core", "id as x", "id as y", "1L as n", "cast(%d as bigint) as lead" % k)
        family.add(rows)
    assert [n for n, _ in family.levels] == [400, 100]
    assert family.found().count() == 0
    family.add(spark.range(40, 45).selectExpr("id as core", "id as x", "id as y", "1L as n", "9L as lead"))
    assert {(r.core, r.n, r.lead) for r in family.found().collect()} == {(k, 2, 0) for k in range(40, 45)}


@pytest.mark.parametrize("step", ["ask_stretches", "ask_windows"])
def test_each_group_is_asked_once(spark, monkeypatch, tmp_path, step):
    monkeypatch.setattr("vigil.llm.common.groups_for", lambda *_: 5)
    ask, calls = getattr(suffixes, step), tmp_path / "calls"

    def noted(key, table, answer):
        with calls.open("a") as f:
            f.write(f"{key[0].as_py()}\n")
        return ask(key, table, answer)

    monkeypatch.setattr(suffixes, step, noted)
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").repartition(3)
    assert sum(r.n_removed for r in suffixes.dedup(docs).collect()) > 10_000
    assert sorted(calls.read_text().split()) == list("01234")
