"""Dataset assembly and leakage audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.operators import prefix


def clean_host(host: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(host)), r"^[a-z][a-z0-9+.-]*://", "")
    text = F.substring_index(F.substring_index(F.substring_index(F.substring_index(text, "/", 1), "?", 1), "#", 1), ":", 1)
    return F.regexp_replace(text, r"^www\.", "")


ROWS_A_TASK, MOST_SHARDS = 1_000_000, 2000


def ranked(rows: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """Adds place, the dense position from 1 by a numeric, date or timestamp column, without one task for all rows.

    Quantiles of the column (at most MOST_SHARDS numbers) are read first and cut it in
    ranges. A row's range follows from its value alone, so both uses of the ranges below
    agree on every run. Ranges are sorted apart and moved by the counts before them.
    Equal values share a range and are placed in any order; nulls come first.
    """
    n = rows.count() if n is None else n
    shards = max(1, min(MOST_SHARDS, n // ROWS_A_TASK))
    cuts = rows.agg(F.percentile_approx(order, [k / shards for k in range(1, shards)], 10 * MOST_SHARDS)).first()[0] if shards > 1 else None
    shard = F.aggregate(F.array(*map(F.lit, sorted(set(cuts)))), F.lit(0), lambda a, x: a + (x < F.col(order)).cast("int")) if cuts else F.lit(0)
    spread = rows.withColumn("__shard", F.coalesce(shard, F.lit(0)))
    spread_n = spread.groupBy("__shard").agg(F.count("*").alias("__n"))
    # one row for each range: MOST_SHARDS at most
    before = spread_n.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = spread.withColumn("__local", F.row_number().over(W.partitionBy("__shard").orderBy(order)))
    return local.join(F.broadcast(before), "__shard").withColumn("place", F.col("__local") + F.col("__before")).drop("__shard", "__local", "__before")


def systematic_sample(rows: DataFrame, order: str, target: int) -> DataFrame:
    """Every k-th row of the ranking, k = max(1, n // target), the first `target` of them."""
    n = rows.count()
    k = max(1, n // target)
    return ranked(rows, order, n).where(((F.col("place") - 1) % k == 0) & (F.col("place") <= k * target))


def without_shared_hosts(phishing: DataFrame, legitimate: DataFrame) -> DataFrame:
    return phishing.join(legitimate.select("host").distinct(), "host", "left_anti")


def first_by_host(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("host").orderBy(order))).where("__n = 1").drop("__n")


def without_conflicts(rows: DataFrame) -> DataFrame:
    """Drops all rows of a host that occurs more than once."""
    once = rows.groupBy("host").agg(F.count("*").alias("__n")).where("__n = 1").select("host")
    return rows.join(once, "host", "left_semi")


HASHED_RANKS = 1_000_003
RAW_ADDRESS = r"^https?://([0-9]{1,3}\.){3}[0-9]{1,3}([:/?#]|$)"


def hashed_rank(key: Column, seed: int) -> Column:
    """A deterministic order for sampling that SQL can repeat."""
    return (key * 7919 + seed) % HASHED_RANKS


def balanced(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many rows of each class as the smaller class has, by hashed rank and key.

    Only counts by (class, rank) are put in order, at most HASHED_RANKS a class; they
    give each class the rank that its last row has. Rows before it stay, and rows of that
    one rank are placed by key.
    """
    by = rows.groupBy(label, hashed_rank(F.col(key), seed).alias("__rank")).agg(F.count("*").alias("__n"))
    least = by.groupBy(label).agg(F.sum("__n").alias("__all")).agg(F.min("__all").alias("__least"))
    run = by.withColumn("__upto", F.sum("__n").over(W.partitionBy(label).orderBy("__rank"))).join(F.broadcast(least))
    # one row a class
    last = run.where((F.col("__upto") >= F.col("__least")) & (F.col("__upto") - F.col("__n") < F.col("__least"))).select(label, F.col("__rank").alias("__last"), (F.col("__least") - F.col("__upto") + F.col("__n")).alias("__left"))
    placed = rows.withColumn("__rank", hashed_rank(F.col(key), seed)).join(last, label)
    inside = placed.where(F.col("__rank") < F.col("__last")).select(*rows.columns)
    edge = placed.where(F.col("__rank") == F.col("__last")).withColumn("__place", F.row_number().over(W.partitionBy(label).orderBy(key))).where(F.col("__place") <= F.col("__left")).select(*rows.columns)
    return inside.unionByName(edge)


def targets(first: DataFrame, second: DataFrame, benign: DataFrame, amount: int) -> DataFrame:
    """url and is_phishing: half bad and half benign addresses, each (line, url) table in the order of its lines.

    The first feed comes before the second, of which four times the half is looked at and
    raw addresses are left out. `amount` bounds what the ordered limits bring together.
    """
    half = amount // 2
    named = second.orderBy("line").limit(4 * half).where(~F.col("url").rlike(RAW_ADDRESS))
    bad = first.orderBy("line").limit(half).withColumn("feed", F.lit(0)).unionByName(named.withColumn("feed", F.lit(1)))
    kept = bad.orderBy("feed", "line").limit(half).select("url", F.lit(1).alias("is_phishing"))
    return kept.unionByName(benign.orderBy("line").limit(half).select("url", F.lit(0).alias("is_phishing")))


def complete(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with all features known; a feature that the table lacks is known in none."""
    missing = {f: F.lit(None).cast("double") for f in features if f not in rows.columns}
    return rows.withColumns(missing).na.drop(subset=list(features))


def backfilled(base: DataFrame, corrections: DataFrame, features: Sequence[str], copies: int, least: int) -> DataFrame:
    """The training table with every complete correction `copies` times; without enough of them, before or after incomplete ones go, the table as it is."""
    columns = [*features, "is_phishing", "url"]
    usable = complete(corrections, features)
    enough = corrections.agg((F.count("*") >= least).alias("many")).join(usable.agg((F.count("*") >= least).alias("left")))
    added = usable.join(F.broadcast(enough), F.col("many") & F.col("left")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return base.select(*columns).unionByName(added.select(*columns))


def backfill_preview(base: DataFrame, corrections: DataFrame, features: Sequence[str], copies: int, least: int) -> DataFrame:
    """One row of counts: what `backfilled` would do."""
    usable = complete(corrections, features)
    given = corrections.agg(F.count("*").alias("given"), F.count_if(F.col("is_phishing") == 0).alias("safe"), F.count_if(F.col("is_phishing") == 1).alias("dangerous"))
    out = given.join(usable.agg(F.count("*").alias("usable"))).join(base.agg(F.count("*").alias("base")))
    added = F.when((F.col("given") >= least) & (F.col("usable") >= least), F.col("usable") * copies).otherwise(0)
    return out.withColumn("added", added).withColumn("total", F.col("base") + F.col("added"))


def feed_lines(lines: DataFrame) -> DataFrame:
    """Trimmed addresses of a feed: no blank lines, comments or raw addresses."""
    text = F.trim("value")
    kept = lines.select("line", text.alias("url")).where(F.col("url").rlike("^https?://"))
    return kept.where(~F.col("url").rlike(RAW_ADDRESS))


def separators(rows: DataFrame, features: Sequence[str], label: str, kinds: int = 10, least: int = 50) -> DataFrame:
    """Values of features with few values that stand for one class alone; severe if one in a hundred rows has them."""
    long = _long(rows, features, F.col(label).alias("y"))
    each = long.groupBy("feature", "value").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    few = each.groupBy("feature").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where(F.col("kinds") <= kinds)
    found = each.join(F.broadcast(few), "feature").where((F.col("n") >= least) & F.col("rate").isin(0.0, 1.0))
    return found.select("feature", "value", "n", "rate", (F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("total") / 100))).alias("severe"))


def duplicates(rows: DataFrame, url: str, label: str) -> DataFrame:
    """Rows beyond the first of their address, and addresses with both labels."""
    each = rows.groupBy(url).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("labels") > 1).alias("conflicts"))


def best_cuts(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature the best accuracy of one cut, from counts by value: running sums over distinct values, in ranges."""
    long = _long(rows, features, F.col(label).alias("y"))
    each = long.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    run = prefix.running(each, ["feature"], "value", ["n", "bad"]).select("feature", F.col("upto_n").alias("n"), F.col("upto_bad").alias("bad"), "all_n", "all_bad")
    right = (F.col("n") - F.col("bad")) + (F.col("all_bad") - F.col("bad"))
    return run.groupBy("feature").agg(F.round(F.max(F.greatest(right, F.col("all_n") - right) / F.col("all_n")), 6).alias("accuracy"))


def _long(rows: DataFrame, features: Sequence[str], *more: Column) -> DataFrame:
    return rows.select(*more, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("x")).select("*", "x.*").drop("x")


def held_out_cuts(rows: DataFrame, features: Sequence[str], label: str, fold: Column, folds: int = 5) -> DataFrame:
    """Per feature the mean accuracy, over the folds held out, of the cut that is best on the other folds.

    `fold` is a whole number below `folds`. Only counts by (feature, value, fold) are put
    in order. Among equally good cuts the smallest value counts, and "larger is bad" before
    "smaller is bad". A cut after the last value foretells one class. Folds without rows
    do not count.
    """
    each = _long(rows, features, F.col(label).alias("y"), fold.alias("fold")).groupBy("feature", "value", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    values = each.groupBy("feature", "value").agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "bad")))).alias("by"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    own = lambda x: F.coalesce(F.col("by")[F.col("k")][x], F.lit(0))
    dealt = values.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select("feature", "value", "k", own("n").alias("test_n"), own("bad").alias("test_bad"), (F.col("n") - own("n")).alias("train_n"), (F.col("bad") - own("bad")).alias("train_bad"))
    run = prefix.running(dealt, ["feature", "k"], "value", ["train_n", "train_bad", "test_n", "test_bad"])

    def right(part: str) -> Column:
        """Rows told right if larger values are bad: good ones up to the value, bad ones after it."""
        return F.col(f"upto_{part}_n") - 2 * F.col(f"upto_{part}_bad") + F.col(f"all_{part}_bad")

    run = run.select("feature", "k", "value", right("train").alias("train"), right("test").alias("test"), F.col("all_train_n").alias("train_all"), F.col("all_test_n").alias("test_all"))
    way = lambda mine, tested, o: F.struct(mine.alias("right"), (-F.col("value")).alias("first"), F.lit(-o).alias("way"), tested.alias("tested"))
    best = F.greatest(way(F.col("train"), F.col("test"), 0), way(F.col("train_all") - F.col("train"), F.col("test_all") - F.col("test"), 1))
    cut = run.groupBy("feature", "k").agg(F.max(best).alias("best"), F.max("test_all").alias("n")).where("n > 0")
    return cut.groupBy("feature").agg(F.round(F.avg(F.col("best.tested") / F.col("n")), 6).alias("accuracy"))


def strongest_features(accuracies: DataFrame, most: int = 8) -> DataFrame:
    """The columns that tell the class best on their own; ties by name."""
    return accuracies.orderBy(F.desc("accuracy"), "feature").limit(most)
