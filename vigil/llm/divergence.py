"""Source divergence audit: which sources of a language differ, and by which terms.

Every (lang, source) group and every lang gives each term that the lang keeps a smoothed
integer share p; two shares p and q differ by f = (p - q)**2 div (p + q). f grows with p
and falls with q as long as p > q.

1. Postings: tasks count the terms of their texts by group and send a row for each
   (lang, source, term); Spark adds up and keeps terms of at least `least` documents of
   the lang. The postings are written once.
2. Terms of a group by upper bounds: postings fall into buckets by count (a bucket for
   each of the six leading bits, so a group has some hundreds at most). The largest p
   and the smallest q of a bucket bound f from above, the smallest p and the largest q
   from below. Buckets are evaluated best bound first, in fronts that grow by GROWTH;
   a group stops once the bounds of all its unseen buckets are strictly below its kth
   value. So ties at the kth value are all seen.
3. Pairs of sources by postings: where one of two sources has no count, f depends on
   that source's smallest share alone, so a histogram of the other's counts is enough.
   Terms that both have correct this, from the postings of each term. Sources are taken
   in blocks of BLOCK and terms in shards, so a task holds one matrix of BLOCK x BLOCK.

Null text, lang and source count as ''. A term is a run of letters A-Z, a-z and of all
characters beyond ASCII, only A-Z lower-cased. A row is a document: repeated rows count
each. Groups without terms have their rows in pairs. Ties in value go to the smaller
item in UTF-8 order. Very long texts and terms are counted whole. Other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm import common

LEAST, TOP = 10, 10
SCALE = 1_000_000_000
FRONT, GROWTH = 64, 8  # terms in the first front of a group, and by how much fronts grow
BLOCK = 128  # sources side by side
SHARD_ROWS = 200_000  # postings or histogram rows aimed at for one task
HELD_TERMS = 300_000  # distinct terms by group that a task counts before it sends them
PIECE = 1 << 20  # shares compared at once

#: A byte to its lower-case letter, or to a blank.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_TERMS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    names = [*GROUP, "term", "n", "docs"]

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in seen.items():
            if times:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(times)), pa.array([source] * len(times)), pa.array([t.decode() for t in times], pa.string()), pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64())], names=names)

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            times, docs = seen[lang, source]
            own = Counter(terms_of(text.as_py()))
            times.update(own)
            docs.update(own.keys())
        if sum(len(x[0]) for x in seen.values()) > HELD_TERMS:
            yield from rows()
            seen.clear()
    yield from rows()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact at any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms)).cast("long")


def differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """Written tables: groups (lang, source, total, kept, lang_total, p0, idx, blocks) and postings (lang, source, term, n, p, q, idx, blocks, p0)."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        common.tune(docs.sparkSession)
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        rows = docs.select(*map(text, ("lang", "source", "text")))
        counts = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
        counts = common.written(counts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).drop("docs")
        found = common.written(counts.drop("docs").join(kept, ["lang", "term"]))
        own = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        # a lang's kept terms: each once, in whichever of its sources comes first
        whole = found.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        groups = rows.select(*GROUP).distinct().join(own, GROUP, "left").join(whole, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
        smallest = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(0)
        numbered = groups.withColumns({"p0": smallest, "idx": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1})
        self.groups = common.written(numbered.withColumn("blocks", (F.max("idx").over(W.partitionBy("lang")) / BLOCK).cast("int") + 1))
        shares = {"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}
        self.postings = common.written(found.join(self.groups, GROUP).withColumns(shares).select(*GROUP, "term", "n", "p", "q", "idx", "blocks", "p0"))


def _bucket() -> Column:
    """The six leading bits of n and how many follow: a number that grows with n."""
    return F.expr("shiftright(n, greatest(length(bin(n)) - 6, 0)) + 32 * greatest(length(bin(n)) - 6, 0)")


def _top(rows: DataFrame, top: int) -> DataFrame:
    best = W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def top_terms(audit: Audit, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms with p > q and the largest f of each group."""
    postings = audit.postings.withColumn("bucket", _bucket())
    extreme = postings.groupBy(*GROUP, "bucket").agg(F.max("p").alias("p1"), F.min("p").alias("p2"), F.min("q").alias("q1"), F.max("q").alias("q2"), F.count("*").alias("terms")).where("p1 > q1")
    bounds = extreme.select(*GROUP, "bucket", "terms", differ(F.col("p1"), F.col("q1")).alias("upper"), F.when(F.col("p2") > F.col("q2"), differ(F.col("p2"), F.col("q2"))).otherwise(-1).alias("lower"))
    group = W.partitionBy(*GROUP)
    up_to = F.sum("terms").over(group.orderBy(F.desc("lower"), "bucket"))
    before = F.coalesce(F.sum("terms").over(group.orderBy(F.desc("upper"), "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the lower bounds alone show that the kth value is `sure` at least
    buckets = bounds.withColumns({"up_to": up_to, "before": before}).withColumn("sure", F.coalesce(F.max(F.when(F.col("up_to") >= top, F.col("lower"))).over(group), F.lit(-1)))
    buckets = common.written(buckets.select(*GROUP, "bucket", "upper", "before", "sure"))
    best = None
    low, high = 0, FRONT
    while True:
        open_ = buckets.withColumn("kth", F.col("sure")) if best is None else _with_kth(buckets, best, top)
        front = open_.where((F.col("before") >= low) & (F.col("before") < high) & (F.col("upper") >= F.col("kth")))
        rows = postings.join(front.select(*GROUP, "bucket"), [*GROUP, "bucket"]).where("p > q").select(*GROUP, F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
        best = common.written(_top(rows if best is None else rows.unionByName(best.drop("rank")), top))
        if _with_kth(buckets, best, top).where((F.col("before") >= high) & (F.col("upper") >= F.col("kth"))).isEmpty():
            return best
        low, high = high, high * GROWTH


def _with_kth(buckets: DataFrame, best: DataFrame, top: int) -> DataFrame:
    kth = best.where(F.col("rank") == top).select(*GROUP, F.col("value").alias("kth"))
    return buckets.join(kth, GROUP, "left").withColumn("kth", F.greatest("sure", "kth"))


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PARTS = "lang string, s int, t int, value long"


def _parts(lang: str, value: np.ndarray, block: tuple[int, int], every: bool) -> pa.Table:
    """Rows of a matrix of pairs (sources of the first block by those of the second), the smaller source first."""
    rows, columns = np.nonzero(np.ones_like(value, bool) if every else value)
    s, t = block[0] * BLOCK + rows, block[1] * BLOCK + columns
    ok = s < t
    return pa.table({"lang": pa.array([lang] * int(ok.sum()), pa.string()), "s": s[ok].astype(np.int32), "t": t[ok].astype(np.int32), "value": value[rows[ok], columns[ok]].astype(np.int64)})


def _both(key: tuple, table: pa.Table) -> pa.Table:
    """Terms that two sources have: what their shares differ beyond what the histograms say of each."""
    lang, a, b = key[0].as_py(), key[1].as_py(), key[2].as_py()
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    idx, p, p0 = (table.column(c).to_numpy().astype(np.int64) for c in ("idx", "p", "p0"))
    order = np.lexsort((idx, term))
    term, idx, p, p0 = term[order], idx[order], p[order], p0[order]
    value = np.zeros(BLOCK * BLOCK, np.int64)
    for step in range(1, 2 * BLOCK):
        i = np.flatnonzero(term[:-step] == term[step:]) if step < len(term) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[(idx[i] // BLOCK == a) & (idx[i + step] // BLOCK == b)]
        j = i + step
        more = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
        np.add.at(value, (idx[i] % BLOCK) * BLOCK + idx[j] % BLOCK, more)
    return _parts(lang, value.reshape(BLOCK, BLOCK), (a, b), False)


def _alone(key: tuple, table: pa.Table) -> pa.Table:
    """All kept terms as if no two sources had one in common. Rows without p are the sources, the others histogram rows; shard 0 also counts terms that neither has."""
    lang, a, b, shard = (k.as_py() for k in key)
    idx, p, p0, times = (table.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("idx", "p", "p0", "times"))
    sources = p < 0
    value = np.zeros((2, BLOCK, BLOCK), np.int64)  # [source with the histogram, the other]; then of the first block, and of the second
    for k, (own, other) in enumerate(((a, b), (b, a))[: 1 + (a != b)]):
        to = np.flatnonzero(sources & (idx // BLOCK == other))
        rows = np.flatnonzero(~sources & (idx // BLOCK == own))
        for at in range(0, len(rows), step := max(1, PIECE // max(1, len(to)))):
            r = rows[at : at + step, None]
            np.add.at(value[k], (idx[r] % BLOCK, idx[to][None, :] % BLOCK), times[r] * (f(p[r], p0[to][None, :]) - f(p0[r], p0[to][None, :])))
    whole = value[0] + (value[0] if a == b else value[1]).T
    here = [np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)]
    there = np.zeros((2, BLOCK), bool)
    for k, block in enumerate((a, b)):
        own = np.flatnonzero(sources & (idx // BLOCK == block))
        here[k][idx[own] % BLOCK] = p0[own]
        there[k][idx[own] % BLOCK] = True
    if shard == 0:
        terms = int(times[sources].max(initial=0))
        whole += terms * f(here[0][:, None], np.maximum(here[1][None, :], 1)) * (there[0][:, None] & there[1][None, :])
    got = _parts(lang, whole, (a, b), shard == 0)
    known = there[0][got.column("s").to_numpy() % BLOCK] & there[1][got.column("t").to_numpy() % BLOCK]
    return got.filter(pa.array(known))


def pairs(audit: Audit) -> DataFrame:
    """lang, source, item (each other source of the lang), value, rank."""
    groups = audit.groups
    by_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    block = (F.col("idx") / BLOCK).cast("int")
    sides = [F.least(block, F.col("other")).alias("a"), F.greatest(block, F.col("other")).alias("b")]
    n = audit.postings.count()
    shards = -(-n // SHARD_ROWS) or 1
    postings = audit.postings.select("lang", "term", "idx", "p", "p0", by_block).select("lang", *sides, F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", "idx", "p", "p0")
    both = postings.groupBy("lang", "a", "b", "shard").applyInArrow(_both, PARTS)
    counted = common.written(audit.postings.groupBy("lang", "idx", "blocks", "p", "p0").agg(F.count("*").alias("times")))
    shards = -(-counted.count() // SHARD_ROWS) or 1
    counted = counted.select("lang", "idx", "p", "p0", "times", by_block).select("lang", *sides, F.pmod(F.xxhash64("p"), F.lit(shards)).alias("shard"), "idx", "p", "p0", "times")
    named = groups.select("lang", "idx", "p0", F.col("kept").alias("times"), by_block).select("lang", *sides, "idx", F.lit(None).cast("long").alias("p"), "p0", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    alone = counted.unionByName(named).groupBy("lang", "a", "b", "shard").applyInArrow(_alone, PARTS)
    total = both.unionByName(alone).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s").alias("one"), F.col("t").alias("two")), F.struct(F.col("t").alias("one"), F.col("s").alias("two")))).alias("way")
    name = lambda k, c: groups.select("lang", F.col("idx").alias(k), F.col("source").alias(c))
    rows = total.select("lang", "value", ways).select("lang", "value", "way.*").join(name("one", "source"), ["lang", "one"]).join(name("two", "item"), ["lang", "two"])
    return _top(rows.select(*GROUP, "item", "value"), 2**31 - 1)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: both parts."""
    made = Audit(docs, least)
    out = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs(made), "pair").unionByName(out(top_terms(made, top), "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), occ AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL
), whole AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v)::HUGEINT)::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (lang_n + 2) // (lang_total + 2 * v)::HUGEINT)::BIGINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN whole w ON g.lang = w.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, b.source AS item, 'pair' AS part, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, term, 'term', (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
