"""Running sums over sorted values without one task for all of them: ranges, and totals carried from range to range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.sources import scratch

RANGE_ROWS, MOST_RANGES = 1_000_000, 2000


def position(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted cuts, `most` at most, lie below the value: a binary search."""
    halves = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda lo, step: F.when((lo + step <= F.size(cuts)) & (F.get(cuts, lo + step - 1) < value), lo + step).otherwise(lo))


def running(each: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds upto_<sum> (over the rows of the group up to this one, by a numeric column that is different in each of its rows) and all_<sum> (over the whole group).

    Quantiles of each group cut it in ranges of about range_rows. A row's range follows
    from its value alone, so all uses agree on every run. Ranges are summed apart; their
    totals, at most MOST_RANGES a group, run up in order; and each range is sorted apart
    and moved by the totals before it. A null value comes first.
    """
    rows = scratch.checkpoint(each)
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // range_rows)))
    keys = [*group, "__range"]
    spread = rows.withColumn("__range", F.lit(0))
    if ranges > 1:
        cuts = F.array_sort(F.array_distinct(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * MOST_RANGES)))
        at = F.coalesce(position(F.col("__cuts"), F.col(order), ranges), F.lit(0))
        marks = rows.groupBy(*group).agg(cuts.alias("__cuts"))
        spread = (rows.join(marks, list(group)) if group else rows.crossJoin(F.broadcast(marks))).withColumn("__range", at).drop("__cuts")
    totals = spread.groupBy(*keys).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    lower = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, *(F.coalesce(F.sum(f"__{s}").over(lower), F.lit(0)).alias(f"before_{s}") for s in sums), *(F.sum(f"__{s}").over(W.partitionBy(*group)).alias(f"all_{s}") for s in sums))
    own = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = spread.withColumns({f"__own_{s}": F.sum(s).over(own) for s in sums})
    return local.join(carried, keys).withColumns({f"upto_{s}": F.col(f"__own_{s}") + F.col(f"before_{s}") for s in sums}).drop("__range", *(f"__own_{s}" for s in sums), *(f"before_{s}" for s in sums))


RANK_SHARDS = 12  # bits of a hash that cut each class for ranks


def class_rank(rows: DataFrame, label: str, key: str, seed: int, tasks: int | None = None) -> DataFrame:
    """Adds place, the position from 0 of a row within its class by a hash of its key, then the key: no task holds a class.

    The leading bits of the hash cut a class in even parts; counts of the parts run up,
    and ranks within a part are moved by them. Rows of equal keys are placed in any order.
    With `tasks`, for few classes, rows move once, to so many tasks, and the counts are broadcast.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    spread = rows.withColumns({"__h": h, "__part": F.shiftrightunsigned(h, 64 - RANK_SHARDS).cast("int")})
    counts = spread.groupBy(label, "__part").agg(F.count("*").alias("__n"))
    lower = W.partitionBy(label).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(label, "__part", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"))
    own = W.partitionBy(label, "__part").orderBy(F.shiftleft("__h", RANK_SHARDS), "__h", key)
    local = (spread if tasks is None else spread.repartition(tasks, "__part")).withColumn("__own", F.row_number().over(own) - 1)
    named = before.withColumnsRenamed({label: "__label", "__part": "__at"})
    joined = local.join(named if tasks is None else F.broadcast(named), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__at")))
    return joined.withColumn("place", F.col("__own") + F.col("__before")).drop("__h", "__part", "__own", "__before", "__label", "__at")


def following(points: DataFrame, asked: DataFrame, group: Sequence[str], point: str, at: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds next to asked: the smallest point of its group above `at`, null where there is none.

    As in `running`, quantiles of the points cut each group in ranges that are sorted
    apart; where a range holds no point above `at`, the first one of the ranges after it counts.
    """
    ranges = max(1, min(MOST_RANGES, -(-points.count() // range_rows)))
    keys = [*group, "__range"]
    both = points.select(*group, F.col(point).alias("__v"), F.lit(1).alias("__is"), *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns if c not in group)).unionByName(asked.select(*group, F.col(at).alias("__v"), F.lit(0).alias("__is"), *(c for c in asked.columns if c not in group)))
    spread = both.withColumn("__range", F.lit(0))
    if ranges > 1:
        marks = points.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx(point, [k / ranges for k in range(1, ranges)], 10 * MOST_RANGES))).alias("__cuts"))
        spread = both.join(marks, list(group), "left").withColumn("__range", F.coalesce(position(F.col("__cuts"), F.col("__v"), ranges), F.lit(0))).drop("__cuts")
    value = F.when(F.col("__is") == 1, F.col("__v"))
    # in falling order a question comes before a point of its own value
    own = W.partitionBy(*keys).orderBy(F.desc("__v"), "__is").rowsBetween(W.unboundedPreceding, 0)
    local = spread.withColumn("__own", F.last(value, ignorenulls=True).over(own))
    later = W.partitionBy(*group).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    # a range with questions alone has a row too
    carried = spread.groupBy(*keys).agg(F.min(value).alias("__first")).select(*keys, F.last("__first", ignorenulls=True).over(later).alias("__later"))
    out = local.where("__is = 0").join(carried, keys)
    return out.select(*asked.columns, F.coalesce("__own", "__later").alias("next"))


def on_chains(points: DataFrame, edges: DataFrame, group: Sequence[str], point: str, most: int) -> DataFrame:
    """The points on the chain that begins at the first point of each group and follows the edges (group, point, next), `most` edges long at most.

    Pointer doubling: each round joins the jumps with themselves and so doubles their
    length; then the chain is filled in from the longest jumps to the single edges. Both
    take about log2(most) rounds, however many points a group has.
    """
    first = points.groupBy(*group).agg(F.min(point).alias(point))
    on = [*group, point]
    # only points that an edge or a beginning leads to can be on a chain
    met = first.unionByName(edges.where(F.col("next").isNotNull()).select(*group, F.col("next").alias(point))).distinct()
    jumps = [scratch.checkpoint(edges.where(F.col("next").isNotNull()).join(met, on, "left_semi"))]
    for _ in range(max(most, 1).bit_length() - 1):
        ahead = jumps[-1].select(*group, F.col(point).alias("next"), F.col("next").alias("__beyond"))
        jumps.append(scratch.checkpoint(jumps[-1].join(ahead, [*group, "next"]).select(*on, F.col("__beyond").alias("next"))))
    reached = first
    for jump in reversed(jumps):
        reached = scratch.checkpoint(reached.unionByName(reached.join(jump, on).select(*group, F.col("next").alias(point))).distinct())
    return reached
