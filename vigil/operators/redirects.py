"""Where addresses lead: redirects followed hop by hop, with the guard before each step.

All addresses that are still under way take one step together: a join with the table of
answers. Those that have arrived, are blocked or ran out of steps leave the join. There
are MOST + 1 steps at most, and the loop ends as soon as nobody is under way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import links as L
from vigil.functions import url as U
from vigil.operators import guard as G
from vigil.sources import scratch

# The status codes that redirect, and the redirects that are followed.
REDIRECTS = [301, 302, 303, 307, 308]
MOST = 10


def joined(url: Column, location: Column) -> Column:
    """The address that a location on an address means."""
    base = lambda k: F.regexp_extract(url, L.BASE, k)
    return L.resolved(location, base(1), base(2), base(3), base(4))


def follow(requests: DataFrame, answers: DataFrame, suffixes: U.Suffixes, most: int = MOST) -> DataFrame:
    """Adds to requests (url) what following its redirects came to.

    answers: url, status, location; one row a url. Added columns: final_url (null where
    nothing was read), status, hops, chain (the addresses left behind), moved (whether
    the registered domain changed; false where one is unknown) and stop: "read",
    "no answer", "too many", or "blocked: " and the reason. A redirect without a
    location is read as it is. Null counts as an empty address, which is blocked. Equal
    addresses are followed once.
    """
    start = F.coalesce("url", F.lit(""))
    none = F.array().cast("array<string>")
    under_way = requests.select(start.alias("start")).distinct().select("start", U.normalised(F.col("start")).alias("url"), none.alias("chain"))
    steps = scratch.checkpoint(answers.where("url is not null")).select(F.col("url").alias("__at"), F.col("status").alias("__status"), F.nullif("location", F.lit("")).alias("__location"))
    arrived: list[DataFrame] = []
    for step in range(most + 1):
        guarded = U.with_host(under_way, suffixes)
        here = guarded.select("start", "url", "chain", "registered", G.blocked(guarded).alias("__blocked"))
        looked = here.join(steps.withColumn("__there", F.lit(True)), F.col("__blocked").isNull() & (F.col("url") == F.col("__at")), "left")
        goes = F.col("__status").isin(*REDIRECTS) & F.col("__location").isNotNull()
        stop = F.when(F.col("__blocked").isNotNull(), F.concat(F.lit("blocked: "), "__blocked")).when(F.col("__there").isNull(), "no answer").when(~F.coalesce(goes, F.lit(False)), "read")
        if step == most:
            stop = F.coalesce(stop, F.lit("too many"))
        judged = scratch.checkpoint(looked.select("start", "url", "chain", "registered", F.col("__status").alias("status"), F.col("__location").alias("location"), stop.alias("stop")))
        arrived.append(judged.where("stop is not null").drop("location"))
        moving = judged.where("stop is null")
        if moving.isEmpty():
            break
        under_way = moving.select("start", joined(F.col("url"), F.col("location")).alias("url"), F.concat("chain", F.array("url")).alias("chain"))
    ended = arrived[0]
    for more in arrived[1:]:
        ended = ended.unionByName(more)
    read = F.col("stop") == "read"
    ended = ended.select("start", F.when(read, F.col("url")).alias("final_url"), F.when(read, F.col("status")).alias("status"), F.size("chain").alias("hops"), "chain", F.col("registered").alias("__to"), "stop")
    origin = suffixes.registered(L.host_of(U.normalised(start)))
    out = requests.withColumns({"__start": start, "__from": origin}).join(ended.withColumnRenamed("start", "__start"), "__start", "left")
    moved = F.when(read, (F.col("__from") != "") & (F.col("__to") != "") & (F.col("__from") != F.col("__to"))).otherwise(False)
    return out.withColumn("moved", moved).drop("__start", "__from", "__to")
