"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Vectors become integers floor(256 x). Adding one coordinate, sqrt(M - |v|^2) for
data and 0 for queries, makes the largest inner product the smallest Euclidean
distance, so triangle bounds hold.

1. A hashed number of data vectors, the square root of all within bounds, are pivots; data go to the cell of the
   nearest pivot. Queries go to cells of a few of the pivots.
2. Summaries: per data cell the count and the k+1 smallest distances to its pivot;
   per query cell the count and the radius. From these each query cell gets a
   distance within which k data vectors besides a query's own must lie.
3. A data vector is needed by a query cell only if the triangle inequality leaves
   it a chance there. Query cells that need much the same data cells form a group of at
   most QUERY_BLOCK queries, and a group is sent one copy of what its cells need.
   Groups are split into blocks of bounded size on both sides.
4. Each block is solved by a matrix product; the blocks' best are ranked a query.

Vectors that are null or hold a null or non-finite component take no part. Shorter
vectors count as padded with zeros. A repeated vec_id counts as often as it comes;
a query's own id never answers it. Ties go to the smaller vec_id. No queries or no
candidates: no rows. Scores are exact while |score| < 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm import common

LEAST_PIVOTS, MOST_PIVOTS = 128, 1024
QUERY_BLOCK, DATA_BLOCK = 8192, 8192
QUERIES_A_CELL = 1024
SHARED = 0.5  # of the rows that two groups need together, what both must need to be one group
SLACK = 1e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    count = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(count), width))
    out[np.arange(width) < count[:, None]] = values
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 x) of every component, of the vectors that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def _cells(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * points @ pivots.T
    cell = square.argmin(1)
    return cell, np.sqrt(np.maximum(((points - pivots[cell]) ** 2).sum(1), 0))


def grouped(need: np.ndarray, rows: np.ndarray, asked: np.ndarray, most: int) -> np.ndarray:
    """A group for each query cell, -1 where nothing is asked.

    need: query cells by data cells; rows: vectors a data cell; asked: queries a query
    cell. A cell joins the group with the largest shared part of the rows that both need,
    if that is SHARED or more and the group stays within `most` queries; else it begins
    one. All arrays have at most MOST_PIVOTS entries a side.
    """
    group = np.full(len(need), -1)
    union, queries = np.zeros((0, need.shape[1]), bool), np.zeros(0, np.int64)
    for c in np.argsort(-(need @ rows), kind="stable"):
        if not asked[c]:
            continue
        both, either = (union & need[c]) @ rows, (union | need[c]) @ rows
        share = np.where(queries + asked[c] <= most, both / np.maximum(either, 1), -1.0)
        g = int(share.argmax()) if len(share) else 0
        if not len(share) or share[g] < SHARED:
            g = len(queries)
            union, queries = np.r_[union, np.zeros((1, need.shape[1]), bool)], np.r_[queries, 0]
        union[g] |= need[c]
        queries[g] += asked[c]
        group[c] = g
    return group


def top_k(vectors: DataFrame, is_query, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score; is_query is a column over vec_id."""
    spark = vectors.sparkSession
    data = quantised(vectors)
    n, width, longest, largest, n_queries = data.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], result)
    width = max(width, 1)
    pivots = pivots or max(LEAST_PIVOTS, min(MOST_PIVOTS, isqrt(int(n))))
    exact_floats = (largest or 0) ** 2 * width < 2**52
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()

    def lifted(v: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(longest - (v**2).sum(1), 0))
        return np.c_[v, extra]

    p_data = lifted(np.array([list(r.v) + [0.0] * (width - len(r.v)) for r in some]), False)
    p_query = p_data[: max(1, min(len(p_data), -(-int(n_queries) // QUERIES_A_CELL)))]
    queries = data.where(is_query)

    def summary(points, query: bool):
        centres = p_query if query else p_data

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near: dict[int, np.ndarray] = {}
            far: dict[int, float] = {}
            count: dict[int, int] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, dist = _cells(lifted(_matrix(batch.column("v"), width), query), centres)
                for c in np.unique(cell).tolist():
                    own = dist[cell == c]
                    near[c] = np.sort(np.r_[near.get(c, np.zeros(0)), own])[: k + 1]
                    far[c] = max(far.get(c, 0.0), float(own.max()))
                    count[c] = count.get(c, 0) + len(own)
            cells = list(near)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([count[c] for c in cells], pa.int64()), pa.array([far[c] for c in cells], pa.float64()), pa.array([near[c].tolist() for c in cells], pa.list_(pa.float64()))], names=["cell", "n", "far", "near"])

        parts = points.select("v").mapInArrow(run, "cell int, n long, far double, near array<double>")
        return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()

    of_data, of_queries = summary(data, False), summary(queries, True)
    between = np.sqrt(np.maximum(((p_query[:, None, :] - p_data[None]) ** 2).sum(2), 0))
    reach, radius = np.full(len(p_query), -1.0), np.zeros(len(p_query))
    asked_of, rows_of = np.zeros(len(p_query), np.int64), np.zeros(len(p_data), np.int64)
    far = np.full(len(p_data), -np.inf)
    for d in of_data:
        rows_of[d.cell], far[d.cell] = d.n, d.far
    for q in of_queries:
        bounds = np.sort(np.concatenate([between[q.cell, d.cell] + q.far + np.array(d.near) for d in of_data]))
        reach[q.cell] = bounds[k] * (1 + SLACK) + SLACK if len(bounds) > k else np.inf
        radius[q.cell], asked_of[q.cell] = q.far, q.n
    need = (between - radius[:, None] - far[None] <= reach[:, None]) & (rows_of > 0)
    group = grouped(need, rows_of, asked_of, QUERY_BLOCK)
    members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
    query_blocks = np.array([-(-int(asked_of[m].sum()) // QUERY_BLOCK) for m in members])
    data_blocks = np.array([max(1, -(-int(rows_of[need[m].any(0)].sum()) // DATA_BLOCK)) for m in members])
    first_block = np.cumsum(query_blocks * data_blocks) - query_blocks * data_blocks

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, dist = _cells(lifted(_matrix(batch.column("v"), width), False), p_data)
            ids = batch.column("vec_id").to_numpy()
            salt = common.mixed(ids.astype(np.uint64))
            for i, cells in enumerate(members):
                wanted = np.zeros(len(cell), bool)
                for c in cells:
                    wanted |= np.abs(between[c, cell] - dist) - radius[c] <= reach[c]
                row = np.flatnonzero(wanted)
                part = (salt[row] % np.uint64(data_blocks[i])).astype(np.int64)
                for b in range(query_blocks[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(first_block[i] + b * data_blocks[i] + part), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["block", "vec_id", "v"])

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, _ = _cells(lifted(_matrix(batch.column("v"), width), True), p_query)
            cell = group[own]
            b = (common.mixed(batch.column("vec_id").to_numpy().astype(np.uint64)) % np.maximum(query_blocks[cell], 1).astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(cell)), data_blocks[cell])
            place = np.arange(len(row)) - np.repeat(np.cumsum(data_blocks[cell]) - data_blocks[cell], data_blocks[cell])
            yield pa.RecordBatch.from_arrays([pa.array(first_block[cell[row]] + b[row] * data_blocks[cell[row]] + place), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["block", "vec_id", "v"])

    def solve(asked: pa.Table, given: pa.Table) -> pa.Table:
        q_id, d_id = asked.column("vec_id").to_numpy(), given.column("vec_id").to_numpy()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q_id) and len(d_id):
            order = np.argsort(d_id, kind="stable")
            q, d, d_id = _matrix(asked.column("v"), width), _matrix(given.column("v"), width)[order], d_id[order]
            if not exact_floats:
                q, d = q.astype(np.int64), d.astype(np.int64)
            least = np.iinfo(np.int64).min
            for a in range(0, len(q_id), 256):
                ids = q_id[a : a + 256]
                score = (q[a : a + 256] @ d.T).astype(np.int64)
                score[ids[:, None] == d_id] = least
                m = min(k, len(d_id))
                limit = np.partition(score, len(d_id) - m, axis=1)[:, len(d_id) - m]
                row, col = np.nonzero((score >= limit[:, None]) & (score > least))
                value = score[row, col]
                best = np.lexsort((col, -value, row))
                row, col, value = row[best], col[best], value[best]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                got.append((ids[row[keep]], d_id[col[keep]], value[keep]))
        cat = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    schema = "block long, vec_id long, v array<double>"
    sent = data.mapInArrow(send_data, schema)
    asked = queries.mapInArrow(send_queries, schema)
    local = asked.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
