"""MinHash near-dedup with tensored banding.

1. One pass: each document's set of distinct word shingles gets a fingerprint, its
   size and two collections of M bands of K minhashes each. A table's key combines
   one band of either collection, so M * M tables cost 2 * M * K minhashes.
2. Documents with equal sets are one class with one representative; the rest of
   the work sees representatives only, however many copies there are.
3. A representative takes part only with bands that another one shares, and its
   table keys combine such bands only. Table keys seen twice link their holders to
   the smallest of them; connected components of these stars are the clusters that
   may hold similar documents.
4. Verification on full sets, in two steps. A cluster is cut into blocks of BLOCK
   documents, and each block is compared exactly with itself and with about PIVOTS
   documents of its cluster. What that links is connected; for each cluster the
   largest true component is its core. Then whatever lies outside the core is cut
   into blocks and compared with all of the cluster. Two documents of the core need
   no comparison: they are connected. A cluster of many copies of one text so costs
   about as much as its rows, and no link between different texts is lost.
   Comparisons return spanning forests of the true links, never pairs.
5. Components of the true links, then every copy takes over its class's component.

A pair at the threshold shares no table with probability MISS at most.

Documents without words (null, empty or blank text) have an empty set and are
linked with nothing. Fewer words than a shingle has: the whole sequence is the one
shingle. Rows that repeat a doc_id carry the same component. A null doc_id never
becomes a component's name; such a row takes its class's component if there is one
and is not kept; an id that is no number counts as null. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common, grouping
from vigil.llm.components import components

SHINGLE = 5
K = 5
MISS = 2e-4
BLOCK = 256
BUNDLE = 512
PIVOTS = 32
BROADCAST_IDS = 500_000
COLUMNS_AT_ONCE = 1 << 14


def bands_for(percent: int) -> int:
    """Bands in a collection so that a pair at the threshold misses every table with probability MISS at most."""
    alone = (percent / 100) ** K
    return math.ceil(math.log(MISS / 2) / math.log(1 - alone))


def sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words, first, _, _ = common.hashed_words(column, lower=True)
    shingle = common.window_hashes(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(shingle[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(common.chained(words, np.array([a]), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(found: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and fingerprint of each set, and its band hashes (two collections beside each other)."""
    size = np.array([len(x) for x in found], np.int64)
    out = np.zeros((len(found), 2 * bands), np.uint64)
    mark = np.zeros(len(found), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate(found)
        start = (np.cumsum(size) - size)[full]
        mark[full] = common.mixed(np.add.reduceat(common.mixed(flat ^ np.uint64(0xF1A9)), start) + size[full].astype(np.uint64))
        seeds = np.random.default_rng(99).integers(1, 2**63 - 1, (2 * bands * K, 2)).astype(np.uint64)
        for band in range(2 * bands):
            key = np.full(len(full), np.uint64(band + 1))
            for k in range(K):
                x, m = seeds[band * K + k]
                least = np.minimum.reduceat((flat ^ x) * (m * np.uint64(2) + np.uint64(1)), start)
                key = common.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[full, band] = key
    return size, mark, out


def _signed(docs: DataFrame, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                size, mark, keys = _signatures(sets(part.column("text")), bands)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * bands * len(size) + 1, 2 * bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(mark.view(np.int64)), listed], names=["doc_id", "n_shingles", "mark", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, mark long, bands array<long>")


def similar_links(found: list[np.ndarray], ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by products of 0/1 matrices in column chunks."""
    n = len(found)
    size = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate(found) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), size)
    _, column, holders = np.unique(flat, return_inverse=True, return_counts=True)
    shared = holders[column] > 1
    column, doc = np.unique(column[shared], return_inverse=True)[1], doc[shared]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS_AT_ONCE])
        part = np.zeros((n, COLUMNS_AT_ONCE), np.float32)
        part[doc[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size - both)
    label = np.arange(n)
    forest = []
    for i in range(n):
        for j in np.flatnonzero(linked[i, :i] & (label[:i] != label[i])):
            if label[j] != label[i]:
                forest.append((int(ids[i]), int(ids[j])))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return forest


def _clusters(reps: DataFrame, bands: int) -> DataFrame:
    """node, label: representatives that share a table key with another, by connected component."""
    one = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    twice = one.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = one.join(twice, ["band", "key"]).groupBy("doc_id").agg(F.collect_list(F.when(F.col("band") < bands, F.col("key"))).alias("left"), F.collect_list(F.when(F.col("band") >= bands, F.col("key"))).alias("right"))
    tables = kept.select("doc_id", "right", F.explode("left").alias("a")).select("doc_id", "a", F.explode("right").alias("b")).select("doc_id", F.xxhash64("a", "b").alias("key"))
    tables = common.checkpoint(tables)
    hubs = tables.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    stars = tables.join(hubs, "key").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    return common.checkpoint(components(stars))


def _verified(docs: DataFrame, members: DataFrame, n: int, pairs: Column, task: Column, percent: int) -> DataFrame:
    """cluster, a, b: spanning forests of the true links in each place (cluster, pair) that members are sent to.

    pairs: the places of a member; task: which of them share a task, null where a place has one of its own.
    """
    side = F.broadcast(members) if n <= BROADCAST_IDS else members
    found = docs.join(side, "doc_id")
    extra = [c for c in members.columns if c != "doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                packed = pa.array([grouping.squeeze(x) for x in sets(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in extra), packed], names=["doc_id", *extra, "members"])

    packed = found.select("doc_id", "text", *extra).mapInArrow(pack, "doc_id long, " + ", ".join(f"{c} {kind}" for c, kind in members.dtypes if c != "doc_id") + ", members binary")
    sent = packed.select("doc_id", "cluster", "members", task.alias("task"), F.explode(pairs).alias("pair"))
    sent = sent.withColumn("task", F.coalesce("task", F.xxhash64("cluster", "pair")))

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("pair", "ascending")])
        cluster, pair, ids = (table.column(x).to_numpy() for x in ("cluster", "pair", "doc_id"))
        packed = table.column("members").to_pylist()
        cut = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (pair[1:] != pair[:-1]), True])
        links = [(int(cluster[a]), *x) for a, b in zip(cut[:-1], cut[1:], strict=True) for x in similar_links([grouping.expand(p) for p in packed[a:b]], ids[a:b], percent)]
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate(("cluster", "a", "b"))})

    return sent.groupBy("task").applyInArrow(verify, "cluster long, a long, b long")


def _outside(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the clusters that have documents outside their core: core, blocks and parts of the cluster (blocks of the core, then of the rest), and the own part."""
    known = components(links.join(members.select("cluster").distinct(), "cluster", "left_semi").select("a", "b"))
    placed = members.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "cluster", F.coalesce("label", "doc_id").alias("label"))
    size = placed.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    cores = size.groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("middle"), F.max("n").alias("inner"), F.sum("n").alias("all")).where("inner < all")
    blocks, others = F.ceil(F.col("inner") / BLOCK), F.ceil((F.col("all") - F.col("inner")) / BLOCK)
    number = F.xxhash64("doc_id")
    core = F.col("label") == F.col("middle")
    own = F.when(core, F.pmod(number, blocks)).otherwise(blocks + F.pmod(number, others))
    return common.checkpoint(placed.join(cores, "cluster").select("doc_id", "cluster", core.alias("core"), blocks.alias("blocks"), (blocks + others).alias("parts"), own.alias("own")))


def link(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    spark = docs.sparkSession
    common.tune(spark)
    bands = bands_for(percent)
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    signed = common.checkpoint(_signed(docs, bands))
    classes = signed.where("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("rep"))
    reps = signed.where("n_shingles > 0").select("doc_id", "bands").join(classes.where("rep is not null").select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    cluster = _clusters(reps, bands)
    sizes = cluster.groupBy("label").agg(F.count("*").alias("n"))
    number = F.xxhash64("node")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = cluster.join(sizes, "label").select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"), blocks.alias("blocks"), F.pmod(number, blocks).alias("own"), (F.pmod(F.xxhash64(number), F.ceil(F.col("n") / PIVOTS)) == 0).alias("pivot"))
    members = common.checkpoint(members)
    n = members.count()
    inside = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    alone = F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-n // BUNDLE))))
    first = common.checkpoint(_verified(docs, members, n, inside, F.when(F.col("blocks") == 1, alone), percent))
    rest = _outside(members.where("blocks > 1"), first)
    across = F.transform(F.sequence(F.when(F.col("core"), F.col("blocks")).otherwise(F.lit(0).cast("long")), F.col("parts") - 1), lambda q: F.least("own", q) * (1 << 31) + F.greatest("own", q))
    second = _verified(docs, rest, rest.count(), across, F.lit(None).cast("long"), percent)
    linked = components(first.unionByName(second).select("a", "b"))
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("mark", F.coalesce("label", "rep").alias("component"))
    return signed.join(named, "mark", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = link(common.table(spark, sf_dir, "documents"), 85)
    return got.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at similarity 0.8: the one with the smallest doc_id."""
    gone = link(docs, 80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
