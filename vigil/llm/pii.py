"""Personal data: patterns propose spans, checks confirm them, context words adjust a score.

Base kinds: email, ip, card, phone. Each pattern is matched leftmost and without
overlaps within its kind; a match that fails its check (address parts at most
255, Luhn, digit counts) is dropped without a retry. The method adds `iban`
spans: the length that the country has, then the ends of words within a match from
the last to the first, until the remainder modulo 97 confirms one. After a confirmed span the search goes
on at its end, after none at the next word of the match. Offsets are code points.

Scores start from the kind's prior; words such as "mail" or "card" within 40
characters before the span raise it, words such as "version" or "order" lower it.

Null text is empty; empty text has no spans and empty strings. Repeated rows are
scanned each by themselves. Spans of two kinds may begin at one place, and all stay;
within a kind the leftmost does. Empty tables give no rows. Other columns are ignored. Searches start at a rare
character (@, + or a digit run), so long texts take linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

# The patterns of the result contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run either matches from its first digit or not at all, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Lengths by country; a country that is not listed may have any.
IBAN_LENGTH = {k: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for k in names.split()}
MAIL_CHARACTERS = re.compile(r"[A-Za-z0-9._%+@-]")

KINDS = ["email", "ip", "card", "phone", "iban"]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95}
FOR = {"email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile"), "iban": ("iban", "bank", "account")}
AGAINST = ("version", "order", "isbn", "example", "invoice", "serial")
NEAR = 40


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        # a longest match holds every shorter one that ends with a word
        ends = [end, *(k for k in range(end - 1, start, -1) if text[k] == " ")]
        length = IBAN_LENGTH.get(text[start : start + 2])
        ends.sort(key=lambda k: k - start - text.count(" ", start, k) != length)
        end = next((k for k in ends if mod97(text[start:k])), 0)
        if end:
            yield start, end
        blank = text.find(" ", start, m.end())
        m = IBAN.search(text, end or (blank if blank >= 0 else m.end()))


def _emails(text: str) -> list[tuple[int, int]]:
    """A match lies in one run of the characters that it may hold, so only runs around an @ are searched."""
    out, at = [], text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and MAIL_CHARACTERS.match(text, a - 1):
            a -= 1
        while b < len(text) and MAIL_CHARACTERS.match(text, b):
            b += 1
        # within the run, each part before an @ that holds a match is as long as it can be
        out += [(a + m.start(), a + m.end()) for m in _linear(text[a:b])]
        at = text.find("@", b)
    return out


def _linear(run: str) -> Iterator[re.Match]:
    """EMAIL.finditer(run) without its quadratic restarts: a match starts after the last match or the last @."""
    at = run.find("@")
    least = 0
    while at >= 0:
        m = EMAIL.match(run, least) if least < at else None
        if m:
            yield m
            least = m.end()
            at = run.find("@", least)
        else:
            least = at + 1
            at = run.find("@", at + 1)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """Confirmed spans: by kind as in KINDS, then by start."""
    if not text:
        return []
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    out += [("iban", *x) for x in _ibans(text)]
    return out


def confidence(text: str, kind: str, start: int) -> float:
    before = text[max(0, start - NEAR) : start].lower()
    score = PRIOR[kind] + 0.1 * any(w in before for w in FOR[kind]) - 0.3 * any(w in before for w in AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def detect(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and parallel arrays kind, start, end, score of its spans."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, scores = [], [], [], []
            for text in batch.column("text").to_pylist():
                got = spans(text)
                kinds.append([x[0] for x in got])
                starts.append([x[1] for x in got])
                ends.append([x[2] for x in got])
                scores.append([confidence(text, x[0], x[1]) for x in got])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["doc_id", "kind", "start", "end", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, kind array<string>, start array<long>, `end` array<long>, score array<double>")


def _count(kind: str) -> Column:
    return F.size(F.filter("kind", lambda x: x == kind))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents"))
    zipped = F.arrays_zip("kind", "start", "end")
    listed = lambda kept: F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(zipped, lambda x: x["kind"] != "iban")
    return found.select("doc_id", *(_count(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(zipped).alias("spans"), "score")
