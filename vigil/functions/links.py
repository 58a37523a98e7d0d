"""Links of a page to other pages of its own site, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BASE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)([^#]*)"
MOST = 3


def without_dots(path: Column) -> Column:
    """Path with `.` and `..` steps taken."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(walked, "/"), F.when(open_end, "/").otherwise(""))).otherwise(path)


def resolved(href: Column, scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    """The absolute form of a reference on a page."""
    site = F.concat(scheme, F.lit("://"), authority)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(own) + 1, F.length(href))
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, without_dots(own), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(site, path, href))
        .when(own == "", F.concat(site, path, query, href))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )


def host_of(url: Column) -> Column:
    authority = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    return F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))


def with_inner_links(pages: DataFrame, most: int = MOST) -> DataFrame:
    """pages: url, html. Adds links: the first different ones, in page order, to the same site, each with a path or a further label in its host. Nulls give none."""
    c = F.col
    base = lambda k: F.regexp_extract("url", BASE, k)
    out = pages.withColumns({"__scheme": base(1), "__authority": base(2), "__path": base(3), "__query": base(4), "__host": host_of(c("url"))})
    out = out.withColumn("__hrefs", F.transform(F.regexp_extract_all(F.regexp_replace("html", UNSEEN, " "), F.lit(HREF), F.lit(1)), lambda x: F.trim(x)))
    out = out.withColumn("__links", F.transform("__hrefs", lambda h: resolved(h, c("__scheme"), c("__authority"), c("__path"), c("__query"))))

    def inner(x: Column) -> Column:
        host = host_of(x)
        deep = F.regexp_extract(x, BASE, 3).rlike("[^/]") | (F.regexp_count(host, F.lit(r"\.")) > 1)
        return x.rlike(r"^(?i)https?://") & (host != "") & (F.contains(host, c("__host")) | F.contains(c("__host"), host)) & deep

    links = F.slice(F.array_distinct(F.filter("__links", inner)), 1, most)
    return out.select(*pages.columns, F.coalesce(links, F.array().cast("array<string>")).alias("links"))
