"""Evidence of a site put together: the stable part from the cache or a fresh probe, the page always fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators import history

# The parts of a probe that change slowly and may be stored.
STABLE = {"age_days": "bigint", "created": "string", "owner_country": "string", "registrar": "string", "ip": "string", "hosting_country": "string", "country_code": "string", "provider": "string", "has_certificate": "boolean", "certificate_issuer": "string", "certificate_days": "bigint", "certificate_fits": "boolean"}


def stable(rows: DataFrame) -> Column:
    """The stable parts of a probe as one struct; parts that the table lacks are null, all others are left behind."""
    return F.struct(*((F.col(k) if k in rows.columns else F.lit(None)).cast(t).alias(k) for k, t in STABLE.items()))


def storable(probes: DataFrame) -> DataFrame:
    """domain and part of the probes that may be stored: those that named a domain and learnt its age or its address. A failed probe is not stored."""
    part = stable(probes)
    return probes.where("domain <> ''").select("domain", part.alias("part")).where("part.age_days is not null or part.ip is not null")


def assembled(requests: DataFrame, cache: DataFrame, probes: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a request with from_cache, the stable parts, the page's columns and failures.

    requests: id, domain, ts, blocked (a reason not to look, or null). cache: domain,
    expires_at, part. probes: id and what was measured anew. pages: id and page columns.
    A hit takes the whole stored part: what it lacks stays null and is not filled from
    a probe. Blocked requests take nothing but the reason. A domain stands once in the
    cache, an id once in probes and pages; missing probes and pages leave nulls.
    """
    fresh = probes.select("id", stable(probes).alias("probed"))
    page = F.struct(*(c for c in pages.columns if c != "id"))
    known = history.cache_lookup(requests, cache).join(cache.select("domain", "part"), "domain", "left")
    rows = known.join(fresh, "id", "left").join(pages.select("id", page.alias("page")), "id", "left")
    looked = F.col("blocked").isNull()
    part = F.when(looked & F.col("hit"), F.col("part")).when(looked, F.col("probed"))
    failures = F.array_compact(F.array(F.when(~looked, F.concat(F.lit("blocked: "), "blocked")), F.when(looked & ~F.col("hit") & F.col("probed").isNull(), "no probe"), F.when(looked & F.col("page").isNull(), "no page")))
    rows = rows.select("id", "domain", F.when(looked, F.col("hit")).alias("from_cache"), part.alias("part"), F.when(looked, F.col("page")).alias("page"), failures.alias("failures"))
    return rows.select("id", "domain", "from_cache", *(F.col("part")[k].alias(k) for k in STABLE), *(F.col("page")[c].alias(c) for c in pages.columns if c != "id"), "failures")


def readable_only(rows: DataFrame) -> DataFrame:
    """Rows of both classes whose page could be read: an address that is gone tells how late one came, not what it was."""
    return rows.where(F.coalesce("readable", F.lit(False)))
