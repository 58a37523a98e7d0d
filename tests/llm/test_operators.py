"""The text operators against brute force on small tables, with nulls, empty and long texts, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.llm import common, decontaminate, knn, langid, lines, neardup, packing, pii, quality, substrings, toxicity

RNG = random.Random(5)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randint(1, 6))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


BASE = prose(60)
TEXTS = [None, "", "   \n\t ", "a", "b b b b", BASE, BASE, BASE.replace(" ", "  \n"), BASE.upper(), prose(40) + " " + BASE[:150] + " " + prose(20), "x " * 40, "x " * 25 + "tail", prose(30000), "One.\nTwo.\n\n three \nTHREE", "é ü 日本   ñ", "a\x00b\x1cc d"] + [prose(RNG.randint(3, 80)) for _ in range(30)]
for _ in range(12):
    w = BASE.split()
    w[RNG.randrange(60)] = "changed"
    TEXTS.append(" ".join(w))
TEXTS += [prose(5) + "\nshared line\n" + prose(5) for _ in range(12)] + ["shared LINE  "] * 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "src0", len(t or ""), 0.5) for k, t in enumerate(TEXTS)]
    rows.append((5, BASE, None, None, None, None))  # a repeated id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_hashes():
    column = pa.array(["Ab  c", None, "", "\x0bAB\tc ", " x"])
    h, first, start, end = common.hashed_words(column, lower=True)
    assert np.diff(first).tolist() == [2, 0, 0, 2, 1]
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert len(common.inside_documents(first, 2)) == 2


def test_lines(docs, empty):
    count = defaultdict(set)
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    everything = [(r.doc_id, r.text) for r in docs.collect()]
    for i, t in everything:
        for key in {strip(x) for x in (t or "").split("\n")}:
            count[key].add(i)
    count = {k: len(v) for k, v in count.items()}
    expected = sorted((i, len((t or "").split("\n")), sum(count[strip(x)] >= 10 and bool(strip(x)) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not (count[strip(x)] >= 10 and strip(x)))) for i, t in everything)
    got = lines.dedup(docs)
    assert sorted((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in got.collect()) == expected
    assert got.columns[: len(docs.columns)] == docs.columns
    assert lines.dedup(empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    made = lines.PerfectHash(keys)
    assert made.size == len(keys) and sorted(made.index(keys).tolist()) == list(range(len(keys)))
    assert lines.PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


def brute_substrings(everything, width=13):
    least = {}
    listed = [(i, words(t)) for i, t in everything]
    for i, w in listed:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(least.get(g, i), i)
    expected = []
    for i, w in listed:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        expected.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(expected)


def test_substrings(docs, empty):
    expected = brute_substrings([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in substrings.dedup(docs).collect()) == expected
    assert any(x[3] for x in expected)
    assert substrings.dedup(empty).count() == 0


def test_symbols_are_consistent():
    """Equal windows pick equal symbols wherever they stand, runs and periods included."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        window = rng.integers(1, 4, 13)
        picked = set()
        for _ in range(3):
            around = [rng.integers(1, 4, rng.integers(0, 20)) for _ in range(2)]
            text = " ".join(map(str, np.r_[around[0], window, around[1]]))
            table = pa.table({"text": [text], "__order": [1]})
            asked = substrings.ask_names((pa.scalar(0),), table)
            shared = pa.table({"kind": pa.array(np.where(asked["y"].to_numpy() == 0, substrings.SYMBOL, substrings.WHOLE)), "x": asked["x"], "y": asked["y"], "z": asked["lo"]})
            group = substrings.Group(table, shared)
            group.name(True)
            start, pick = group.windows(np.zeros(1, bool))
            picked.add(int(pick[list(start).index(len(around[0]))]))
        assert len(picked) == 1


def test_substrings_stand_on_their_symbols(spark, monkeypatch):
    """Where symbols do not agree between documents, repeats are no longer found: removal goes through them."""
    passage = prose(40)
    table = spark.createDataFrame([(1, prose(9) + " " + passage + " " + prose(9)), (2, prose(30) + " " + passage)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup(table).collect()} == {1: 0, 2: 40}
    real = substrings.ask_picks

    def wrong(key, table, answer):
        asked = real(key, table, answer)
        return asked.set_column(0, "x", pa.array(asked["x"].to_numpy() ^ 1))

    monkeypatch.setattr(substrings, "ask_picks", wrong)
    assert sum(r.n_removed for r in substrings.dedup(table).collect()) == 0


def alternating(n, a, b):
    """The Thue-Morse sequence of two symbols: it and its complement have equal polynomial hashes modulo 2**64."""
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_texts_are_told_apart(spark, n):
    one, other = ("".join(alternating(n, *x)) for x in ("ab", "ba"))
    made = lines.dedup(spark.createDataFrame([(k, one if k < 9 else other) for k in range(10)], "doc_id long, text string"))
    assert made.agg(F.sum("__n_dropped")).first()[0] == 0
    got = neardup.link(spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string"), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}
    words_of_two = [" ".join(["x"] * 6 + [w] + ["y"] * 6) for w in (one, other)]
    got = substrings.dedup(spark.createDataFrame(list(enumerate([*words_of_two, words_of_two[0]])), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0, 2: 13}
    many = [" ".join(alternating(n, *x)) for x in ("ab", "ba")]
    rows = [(k, t) for k, t in enumerate([*many, many[0], many[1][: n // 2]])]
    got = sorted(tuple(r) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_substrings(rows)


def test_lines_count_documents(spark):
    """Rows that repeat an id are one document; rows without one are documents of their own."""
    rows = [(k % 3, "often\nown") for k in range(12)] + [(None, "nameless")] * 10 + [(k, "ten") for k in range(20, 30)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r["__n_dropped"]) for r in got} == {(k, 0) for k in range(3)} | {(None, 1)} | {(k, 1) for k in range(20, 30)}


def test_lines_of_one_hash_are_counted_apart():
    key = np.array([5, 5, 5, 7, 7, 5], np.uint64)
    mark = np.array([1, 2, 1, 3, 3, 2], np.uint32)
    assert lines.frequent(key, mark, np.array([6, 9, 4, 5, 4, 2]), 10).tolist() == [True, True, True, False, False, True]


def brute_components(rows, percent):
    lower = {k: k + 32 for k in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_neardup(docs, empty, percent):
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect()], percent)
    got = neardup.link(docs, percent).collect()
    assert len(got) == docs.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert neardup.link(empty, percent).count() == 0


@pytest.mark.parametrize("pivots", [1, 8])
def test_neardup_blocks(spark, monkeypatch, pivots):
    """Clusters cut into many blocks, with cores and documents outside them, give the same components."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rows = []
    text = prose(50).split()
    for k in range(25):
        text = text[:]
        text[RNG.randrange(50)] = f"w{k}"
        rows.append((k, " ".join(text)))
    same = prose(200).split()
    for k in range(40, 80):  # copies of one text, most of them linked and some not
        text = same[:]
        for j in RNG.sample(range(200), 1 if k < 70 else 5):
            text[j] = f"v{k}"
        rows.append((k, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == brute_components(rows, 80)


def test_neardup_leaves_out_connected_pairs(spark, monkeypatch):
    """A cluster whose documents are connected after the first step needs no second one."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    members = spark.createDataFrame([(k, 0, 3, k % 3, k == 1) for k in range(10)], "doc_id long, cluster long, blocks long, own long, pivot boolean")
    star = [(0, k, 1) for k in range(10) if k != 1]
    links = lambda rows: spark.createDataFrame(rows, "cluster long, a long, b long")
    assert neardup._outside(members, links(star)).count() == 0
    rest = {r.doc_id: (r.core, r.parts) for r in neardup._outside(members, links(star[:-2])).collect()}
    assert len(rest) == 10 and {k for k, r in rest.items() if not r[0]} == {8, 9} and {r[1] for r in rest.values()} == {3}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.best_fit(docs, packing.default_tokenizer()).toPandas()
    expected = defaultdict(list)
    for r in docs.collect():
        expected[r.doc_id].append(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    for i, own in got.groupby("doc_id"):
        ids = expected[i][0]
        assert own.length.sum() == sum(map(len, expected[i]))
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.length == 1024 or r.piece == 0
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum().to_numpy()[:-1]]).all()
    assert packing.best_fit(empty, packing.default_tokenizer()).count() == 0


def test_packing_in_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 500)
    rng = np.random.default_rng(2)
    cut = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 1025, 3000))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut).toPandas()
    sums = got.groupby("sequence_id").length.sum()
    assert len(got) == 3000 and sums.max() <= 1024 and len(sums) <= 1.03 * got.length.sum() / 1024
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum().to_numpy()[:-1]]).all()


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    encoder = packing.Encoder(packing.default_tokenizer())
    for text in [*filter(None, TEXTS), "don't I'LL  two\n\n\tx ½² 😀 <|endoftext|> \r\n"]:
        assert encoder.ids_with_added(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_ids_are_those_of_an_unchanged_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"{end}start", f"stop{end}", f"one  {end}\n\n{end} two ", f"é{end}日本 <|endoftext| > <|ENDOFTEXT|>", f"<|{end}|>", f"{prose(2000)} {end} {prose(900)}", *TEXTS]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.default_tokenizer()).collect()
    ids = [np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert {r.doc_id for r in got} == set(range(len(texts))) and sum(r.length for r in got) == sum(map(len, ids))
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32, texts[r.doc_id]


def test_knn_groups_of_cells(spark, monkeypatch):
    """Many query cells over clusters that lie apart: cells share copies only where they need the same data, and nothing is lost."""
    monkeypatch.setattr(knn, "QUERIES_A_CELL", 4)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    monkeypatch.setattr(knn, "DATA_BLOCK", 64)
    draw = np.random.default_rng(5)
    centre = draw.normal(size=(12, 8))
    v = centre[np.arange(600) % 12] / np.linalg.norm(centre[np.arange(600) % 12], axis=1)[:, None] + draw.normal(scale=0.01, size=(600, 8))
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * v).astype(int)
    want = []
    for q in range(0, 600, 5):
        order = sorted((-(whole[q] @ whole[i]), i) for i in range(600) if i != q)[:5]
        want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(order)]
    assert sorted(tuple(r) for r in knn.top_k(table, F.col("vec_id") % 5 == 0, pivots=48).collect()) == want
    need = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 1, 1, 1], [1, 1, 1, 1]], bool)
    group = knn.grouped(need, np.array([10, 10, 10, 1]), np.array([5, 5, 5, 5, 0]), 10)
    assert group[0] == group[1] != group[2] and group[4] == -1
    assert len(set(knn.grouped(need, np.array([10, 10, 10, 1]), np.array([5, 5, 5, 5, 0]), 5)[:4])) == 4


def test_knn(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (300, 8)).astype(np.float32).tolist()
    v[7], v[8], v[9], v[11] = None, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] * 8
    v[100:160] = [v[0]] * 60
    table = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v)], "vec_id long, embedding array<float>, rank int")
    fine = {k: [int(np.floor(256 * float(y))) for y in x] for k, x in enumerate(v) if x and None not in x and np.isfinite(x).all()}
    expected = []
    for q in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=True)), c) for c in fine if c != q)[:5]
            expected += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in knn.top_k(table, F.col("vec_id") % 50 == 0, pivots=16).collect()) == sorted(expected)
    assert knn.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.top_k(table.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_pii_against_plain_patterns(docs):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    alphabet = "a1@.-+ ()5%"
    for _ in range(3000):
        text = "".join(RNG.choices(alphabet, k=30))
        got = pii.spans(text)
        assert [x[1:] for x in got if x[0] == "email"] == [m.span() for m in email.finditer(text)], text
        assert [x[1:] for x in got if x[0] == "ip"] == [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))], text
    assert ("card", 4, 23) in pii.spans("card 4111 1111 1111 1111".replace("card ", "pay ")) and ("iban", 0, 22) in pii.spans("GB82WEST12345698765432")
    assert pii.spans(None) == [] and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.detect(docs).count() == docs.count()


def test_iban_beside_other_capitals_and_numbers():
    spans = lambda text: [x[1:] for x in pii.spans(text) if x[0] == "iban"]
    assert spans("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX") == [(0, 27)]
    assert spans("DE89370400440532013000 12 EUR") == [(0, 22)] and spans("GB82WEST12345698765432 A") == [(0, 22)]
    assert spans("NO93 8601 1117 947 IS FINE") == [(0, 18)] and spans("NO9386011117947") == [(0, 15)]
    assert spans("DE89370400440532013000 GB82WEST12345698765432") == [(0, 22), (23, 45)]
    assert spans("AB12 CD34 GB82WEST12345698765432 X1 Y2") == [(10, 32)]
    assert spans("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX") == [] and spans("xDE89370400440532013000") == []
    assert spans("DE89370400440532013000x 12") == [] and spans("DE89370400440532013000, MT84MALT011000012345MTLCAST001S Z") == [(0, 22), (24, 55)]


def test_decontamination(spark, docs, empty):
    item = prose(30)
    w = item.split()
    w[3], w[20] = "new", "other"
    del w[11]
    texts = {1: prose(50) + " " + item + ". " + prose(9), 2: " ".join(w), 3: prose(60), 4: item[: len(item) // 2], 5: None, 6: ""}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, "too few words"), (12, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(table, items).collect()}
    assert got == {(1, 9): 0, (2, 9): 3}
    assert sorted(r.doc_id for r in decontaminate.clean(table, items).collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 3, 5, 8, 12, 20, 40, 64])
def test_decontamination_recall(length):
    """Items of a length at the full share of edits, beside items of frequent words: at least 0.95 of the leaks that brute force finds, with its distances."""
    found = total = 0
    for seed in range(3):
        rng = random.Random(1000 * length + seed)
        items = [" ".join(rng.choices(WORDS[:40] if k % 3 == 0 else WORDS, k=length)) for k in range(40)]
        index = decontaminate.Index(list(range(40)), items)
        draw = np.random.default_rng(seed)
        texts = []
        for k, item in enumerate(items):
            numbered = decontaminate.edited(draw, list(range(length)), length // 5, length)
            w = [item.split()[x] if x < length else "zz" for x in numbered]
            texts.append([[], ["yy"] * 9, prose(12).split()][k % 3] + w + [[], ["yy"] * 9, prose(12).split()][k % 3])
        got = index.leaks(pa.array([" ".join(x) for x in texts]))
        for k, w in enumerate(texts):
            least = smallest_edits(items[k].split(), w)
            assert least <= length // 5
            total += 1
            found += got[k].get(k) == least
            assert all(smallest_edits(items[i].split(), w) == e for i, e in got[k].items())
    print(length, len(index.walks.odd), found / total)
    assert found >= (0.95 if length >= 5 else 1) * total


def labelled(spark, good):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, prose(40) + (good if bad else " ") + prose(20)))
        labels.append((k, int(not bad), int(bad)))
    return spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(902, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    table, labels = labelled(spark, " zzvvq zzvvq ")
    got = toxicity.score(table, toxicity.fit(table, labels)).toPandas().set_index("doc_id")
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got.score[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert got.score.between(0, 1).all() and len(got) == 402
    assert toxicity.score(empty, toxicity.fit(table, labels.limit(0))).count() == 0


def brute_evidence(rows, toxic):
    """Mean evidence of each document by a plain model over dictionaries; rows: (id, text); toxic: label by id."""
    lower = {k: k + 32 for k in range(65, 91)}
    split = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").translate(lower))
    count = [defaultdict(int), defaultdict(int)]  # (history or "", word); "^" before a first word
    for i, t in rows:
        if i in toxic and t is not None:
            w = split(t)
            for x in {*(("", x) for x in w), *zip(["^", *w], w)}:
                count[toxic[i]][x] += 1
    deviations = (2 * np.log(min(sum(toxic.values()), len(toxic) - sum(toxic.values())))) ** 0.5
    every = set(count[0]) | set(count[1])
    total = [defaultdict(int), defaultdict(int)]
    after, before = defaultdict(int), defaultdict(int)
    for h, x in every:
        after[h] += 1
        before[x] += h != ""
        for c in (0, 1):
            total[c][h] += count[c].get((h, x), 0)
    among, types = sum(before.values()), len(before)
    shared = lambda x: (max(before.get(x, 0) - 0.75, 0) + 0.75 * types / (types + 1)) / among

    def excess(c, h, x):
        own, n, t = count[c].get((h, x), 0), count[0].get((h, x), 0) + count[1].get((h, x), 0), total[0][h] + total[1][h]
        if not total[c][h]:
            return 0.0
        r = total[c][h] / t
        return max(own - r * n - deviations * (r * n * (1 - r)) ** 0.5 - (1.0 if h else 0.75), 0) / total[c][h]

    freed = [defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)]
    for h, x in every:
        for c in (0, 1):
            if (e := excess(c, h, x)) > 0:
                freed[c][h] -= e
    raised = lambda c, x: excess(c, "", x) / shared(x) + freed[c][""]

    def evidence(h, x):
        if x not in before:
            return float(np.log(freed[1][""] / freed[0][""]) + np.log(freed[1][h] / freed[0][h]))
        n, t = count[0].get((h, x), 0) + count[1].get((h, x), 0), total[0][h] + total[1][h]
        back = (max(n - 0.75, 0) + 0.75 * after[h] * shared(x)) / t if t else shared(x)
        p = [excess(c, h, x) + freed[c][h] * back * raised(c, x) for c in (0, 1)]
        return float(np.log(p[1] / p[0]))

    return {i: float(np.mean([evidence(h, x) for h, x in zip(["^", *split(t)], split(t))] or [0.0])) for i, t in rows}


def test_toxicity_of_words_side_by_side(spark):
    """Two words that both classes have alike, side by side in toxic texts alone: only pairs can tell."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        w = rng.choices(WORDS, k=rng.randint(20, 60))
        for _ in range(3):
            at = rng.randrange(len(w) - 6)
            w[at:at] = ["alpha", "omega"] if k % 2 else ["alpha", *rng.choices(WORDS, k=2), "omega"]
        rows.append((k, " ".join(w)))
        labels.append((k, k % 2))
    docs, labelled_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labelled_)).toPandas()
    held = got[[zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id]]
    bad, fine = (held.mean_evidence[held.doc_id % 2 == c].to_numpy() for c in (1, 0))
    assert np.mean(bad[:, None] > fine) > 0.97


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_toxicity_against_a_plain_model(spark, sf, monkeypatch, frequent):
    """Evidence and score, with the whole model broadcast and with most of it joined."""
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    docs = docs.unionByName(docs.where("doc_id < 3"))  # rows that come twice
    model = toxicity.fit(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, got = brute_evidence(rows, toxic), toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and model.whole == (frequent > 5)
    for r in got:
        assert r.mean_evidence == pytest.approx(expected[r.doc_id], abs=1e-5)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.weights @ [1, r.mean_evidence]))), abs=1e-9)
    kept = {r.doc_id for r in toxicity.stage(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in got if r.score < 0.5} and docs.count() > len(kept)


@pytest.mark.parametrize(("few", "apart", "count"), [(1, 0, 6), (1, 1, 6), (0, 0, 6), (1, 0, 1), (0, 1, 1)])
def test_toxicity_with_few_labels_on_one_side(spark, few, apart, count):
    """A class whose rows fall all on one side of the calibration split still gives scores that differ; few toxic rows are enough to rank by (few ordinary ones show little of ordinary prose)."""
    table, labels = labelled(spark, " zzvvq zzvvq " * 4)
    side = (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int")
    rare = labels.where((F.col("toxic") == few) & (side == apart) & (common.remainder("doc_id", 5) != 0)).orderBy("doc_id").limit(count)
    assert rare.count() == count
    model = toxicity.fit(table, labels.where(F.col("toxic") == 1 - few).unionByName(rare))
    got = toxicity.score(table, model).where("doc_id < 400").toPandas()
    toxic = got.doc_id % 4 == 0
    assert got.score.nunique() > 1  # texts without a telling expression are alike
    assert few == 0 or np.mean(got.score[toxic].to_numpy()[:, None] > got.score[~toxic].to_numpy()) > 0.95


def test_quality(spark, empty):
    table, labels = labelled(spark, " !! $$$ " * 12)
    got = quality.score(table, quality.fit(table, labels)).toPandas().set_index("doc_id")
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got.score[k] >= 0.7) == (k % 4 != 0) for k in held]) > 0.95
    assert got.score.between(0, 1).all() and len(got) == 402
    assert quality.score(empty, quality.fit(table, labels.limit(0))).count() == 0


def plain_statistics(text):
    data = (text or "").encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", data)
    rows = [x for x in data.split(b"\n") if x]
    n, w, k = max(len(data), 1), max(len(found), 1), max(len(rows), 1)
    count = lambda pattern: len(re.findall(pattern, data))
    symbols = sum(b in b"#$%&*@^~<>{}[]\\_=+/" for b in data)
    again = sum(a == b for a, b in zip(found, found[1:]))  # noqa: B905
    return [np.log1p(len(data)), np.log1p(len(found)), (len(data) - count(rb"\n")) / w, count(rb"[A-Z]") / n, count(rb"[0-9]") / n, symbols / w, count(rb"\|") / w, count(rb"!") / w, count(rb"[.,;:?]") / w, len(found) / k, count(rb"[\x80-\xff]") / n, len(set(found)) / w, again / w, 1 - len(set(rows)) / k, sum(x[:1].isupper() for x in found) / w, sum(len(x) <= 3 for x in found) / w]


def test_quality_against_plain_rules(spark, sf):
    """Statistics, rules and scores of the query's whole table, worked out in plain code from the model's weights."""
    documents, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(documents, labels)
    assert len(model.rules) > 3
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in quality.score(documents, model).collect():
        plain = plain_statistics(texts[r.doc_id])
        assert np.allclose([r[x] for x in quality.STATISTICS], plain, rtol=1e-12), r.doc_id
        given = [r[x] for x in quality.STATISTICS]
        total = model.base + sum(weight for rule, weight in model.rules if all((given[k] <= limit) == at_most for k, at_most, limit in rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_tree_paths_are_rules():
    tree = "Model\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0E-4)\n    Predict: 0.0\n   Else (feature 1 > 2.0E-4)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    low, high = (0, True, 1.5), (0, False, 1.5)
    assert quality.tree_rules(tree) == [(low,), (low, (1, True, 2e-4)), (low, (1, False, 2e-4)), (high,)]


def test_langid_against_plain_vectors(spark, sf):
    """Predictions and cosines of the query's whole table against bundles made letter by letter."""
    v = langid._vectors().astype(np.int64)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    bundles, sums = {}, defaultdict(lambda: np.zeros(langid.DIMENSIONS, np.int64))
    for r in rows:
        symbols = [0, *(langid._symbol(ord(c)) for c in r.text or ""), 0]
        seen = defaultdict(int)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):  # noqa: B905
            seen[a, b, c] += b > 0
        bundles[r.doc_id] = sum((n * np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for (a, b, c), n in seen.items() if n), np.zeros(langid.DIMENSIONS, np.int64))
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            sums[r.lang] += bundles[r.doc_id]
    for r in langid.op2_langid(spark, sf).collect():
        own = bundles[r.doc_id]
        cosine = {x: own @ y / max(np.linalg.norm(own) * np.linalg.norm(y), 1e-9) for x, y in sums.items()}
        best = max(cosine.values())
        if r.lang_pred == "und":
            assert not own.any() and r.score == 0
        else:
            assert cosine[r.lang_pred] > best - 1e-5 and abs(r.score - min(max(best, 0), 1)) < 1e-5


def test_langid(spark, sf, empty):
    got = langid.op2_langid(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    few = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "hello")], "doc_id long, text string")
    named = {r.doc_id: r.lang_pred for r in langid.predict(few, langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert [named[k] for k in (1, 2, 3)] == ["und"] * 3 and named[4] != "und"
    assert langid.fit(empty) == {} and langid.predict(few, {}).count() == 4


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert got.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


CLASHING = ["score", "predicted", "held_out", "lang_pred", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_words", "n_removed", "n_shingles", "component_id", "kept", "n_lines", "n_dropped", "hash", "key", "id", "n", "grp", "shard", "band", "label", "toxic", "quality", "item_id", "edits", "spans", "words"]


@pytest.fixture(scope="module")
def odd(spark, sf):
    """All documents, and rows that are null everywhere or but for their text; more columns have the names that operators use."""
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("clash") for c in CLASHING})
    text = "some words in a text without an id yet long enough for windows of thirteen words"
    none = spark.createDataFrame([(None, x) for x in (None, None, text, text)], "doc_id long, text string")
    return d.unionByName(none, allowMissingColumns=True)


def test_nulls_and_clashing_names(spark, sf, odd):
    n = odd.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumns({c: F.lit("clash") for c in ("text", "score")})
    labels = labels.unionByName(spark.createDataFrame([(None, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").withColumns({c: F.lit("clash") for c in ("doc_id", "words", "edits")})
    items = items.unionByName(spark.createDataFrame([(None, "x y z"), (None, None)], "item_id long, text string"), allowMissingColumns=True)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumns({c: F.lit("clash") for c in ("score", "rank", "query_id", "pivot")})
    vectors = vectors.unionByName(spark.createDataFrame([(None, [1.0] * 3), (None, None)], "vec_id long, embedding array<float>"), allowMissingColumns=True)
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == n
    assert quality.score(odd, quality.fit(odd, labels)).count() == n
    assert langid.predict(odd, langid.fit(odd)).count() == n
    assert pii.detect(odd).count() == n
    assert substrings.dedup(odd).count() == n
    assert neardup.link(odd, 80).count() == n
    assert lines.dedup(odd).count() == n
    packed = packing.best_fit(odd, packing.default_tokenizer())
    assert packed.where("piece = 0 and doc_id is null").count() == 4
    leaking = {r.doc_id for r in decontaminate.leaks(odd, items).collect()}
    assert None not in leaking and decontaminate.clean(odd, items).count() == n - odd.where(F.col("doc_id").isin(*leaking)).count()
    assert knn.top_k(vectors, F.col("vec_id") % 50 == 0).where("vec_id is null or query_id is null").count() == 0


def test_stages_on_odd_rows(spark, sf, odd, empty):
    """Every stage but the last returns its columns; packing covers all rows; an empty table gives none."""
    import corpus_pipeline

    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = common.written(stage(spark, docs, sf))
        assert got.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
        docs = got
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, sf).where("piece = 0").count() == docs.count() and last(spark, docs.limit(0), sf).count() == 0


def smallest_edits(item, text):
    """Fewest word edits between the item and any stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    component = brute_components(rows, 80)
    assert sorted(r.doc_id for r in neardup.stage(spark, docs, sf).collect()) == sorted(i for i, (_, c) in component.items() if c == i)
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate({k: k + 32 for k in range(65, 91)}))
    items = [split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for i, t in rows:
        text = split(t or "")
        held = set(text)
        # an item with more foreign words than edits allowed cannot leak: each costs an edit
        likely = [x for x in items if x and sum(w not in held for w in x) <= int(decontaminate.EDIT_SHARE * len(x))]
        if not any(smallest_edits(x, text) <= int(decontaminate.EDIT_SHARE * len(x)) for x in likely):
            clean.append(i)
    assert sorted(r.doc_id for r in decontaminate.stage(spark, docs, sf).collect()) == sorted(clean)
    assert len(clean) < len(rows)


def brute_lines(rows, least=10):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[strip(x)].add(i)
    stays = lambda x: not strip(x) or len(held[strip(x)]) < least
    return [(i, t if t is None else "\n".join(filter(stays, t.split("\n")))) for i, t in rows]


def test_pipeline_against_brute_force(spark, sf):
    """All stages one after the other: what toxicity keeps is checked by its own tests, every later stage by plain code on its own input."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = common.written(toxicity.stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    rows = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    component = brute_components(rows, 80)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate({k: k + 32 for k in range(65, 91)}))
    items = [split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = {}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in rows:
        text = split(t or "")
        held = set(text)
        likely = [x for x in items if x and sum(w not in held for w in x) <= int(decontaminate.EDIT_SHARE * len(x))]
        if not any(smallest_edits(x, text) <= int(decontaminate.EDIT_SHARE * len(x)) for x in likely):
            expected[i] = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got.doc_id) == set(expected) and 0 < len(expected) < docs.count()
    for r in got.itertuples():
        assert zlib.crc32(expected[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(map(len, expected.values())) and got.groupby("sequence_id").length.sum().max() <= 1024


def test_digests(spark, sf):
    got = substrings.op7_substrings(spark, sf).collect()
    expected = brute_substrings([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert sorted(tuple(r) for r in got) == [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, kept, n, gone in expected]
    assert any(x[3] for x in expected)
