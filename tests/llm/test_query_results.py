"""Registered queries on whole given tables against plain code, SQL or held-out labels."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from vigil.llm import divergence, pii, queries, spelling, suffixes, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and passes_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_op8_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op8_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in want) for kind in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) and sum(not s.startswith("iban") for s in r.spans.split(",") if s) == len(want)
    assert sum(r.n_card for r in got) > 0 and sum(r.n_phone for r in got) > 0


@pytest.mark.parametrize("text", ["4111-1111-1111-1111 4111 1111 1111 1112", "+1 (555) 010-9999 +12 34", "1.2.3.4.5 300.1.1.1", "+49 30 123456789012345 4111111111111111", "a@b a@b.c.d. @x.y"])
def test_base_spans_of_made_texts(text):
    assert [s for s in pii.spans(text) if s[0] != "iban"] == base_spans(text)


def test_op1_ranks_held_out_documents(spark):
    """The mean evidence alone, and the score at 0.5, on labels that were never read."""
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    got = toxicity.op1_toxicity(spark, sf).where("held_out").select("doc_id", "mean_evidence", "predicted").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    bad, fine = (np.array([r.mean_evidence for r in got if toxic.get(r.doc_id) == c]) for c in (1, 0))
    assert np.mean((bad[:, None] > fine) + (bad[:, None] == fine) / 2) > 0.94
    hit = [toxic[r.doc_id] for r in got if r.predicted and r.doc_id in toxic]
    assert np.mean(hit) > 0.9 and sum(hit) > 0.85 * len(bad)


def test_op11_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    data = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen: dict[bytes, int] = {}
    for d in data.values():
        for k in range(len(d) - 399):
            key = hashlib.blake2b(d[k : k + 400], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    got = suffixes.op11_suffixes(spark, sf).collect()
    assert len(got) == len(data) and sum(r.n_removed for r in got) > 0
    for r in got:
        d = data[r.doc_id]
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 399):
            if seen[hashlib.blake2b(d[k : k + 400], digest_size=16).digest()] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(d, np.uint8)[~gone[: len(d)]].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), int(gone.sum()), int(np.sum(gone[1:] < gone[:-1])), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("module", [divergence, spelling])
def test_queries_with_sql(spark, module):
    sf = "/root/testdata/sf0.001"
    name = next(k for k, sql in queries.ORACLE.items() if sql is module.ORACLE)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(module.ORACLE)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    plain = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(plain(r[c] for c in want.columns) for r in got.collect()) == sorted(map(plain, want.fetchall()))
