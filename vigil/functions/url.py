"""URL parsing and the lexical features of a host, as Column expressions: no Python runs on the data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import dictionaries as D

TYPO_LENGTH, FAR = 6, 3
MOST_RULES = 100_000
PLAIN, WILD, LEFT_OUT = 1, 2, 4


def normalised(url: Column) -> Column:
    """Trims, drops spaces, and gives the text a scheme; `scheme:rest` gets its slashes unless the rest starts with a digit (a port)."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", ""), " ", "")
    return (
        F.when(text == "", "")
        .when(text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), text)
        .when(text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:[^0-9/]") | text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/([^/]|$)"), F.regexp_replace(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", "$1://"))
        .otherwise(F.concat(F.lit("http://"), text))
    )


def reject_reason(url: Column) -> Column:
    """Null if the text may be scanned."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", ""), " ", "")
    rest = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?", "")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    host = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    fine = host.rlike(r"(?i)^(([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}|([0-9]{1,3}\.){3}[0-9]{1,3}|localhost)$")
    return F.when(F.length(F.coalesce(url, F.lit(""))) > 2048, "too long").when(text == "", "empty").when(~fine, "no host")


class Suffixes:
    """A public-suffix table: a name is a suffix, `*.x` makes one of any label before x, `!y.x` leaves y.x out of that.

    The rules travel as one literal: an array of small maps, a rule found by the hash of
    its name. So a suffix is an expression that works on any host, also within arrays.
    Tables of up to MOST_RULES rules (the public list has about 10,000).
    """

    def __init__(self, rules: DataFrame):
        rule = F.lower(F.trim("rule"))
        kind = F.when(rule.startswith("!"), LEFT_OUT).when(rule.startswith("*."), WILD).otherwise(PLAIN)
        names = rules.where(rule != "").select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("name"), kind.alias("kind")).distinct().groupBy("name").agg(F.sum("kind").alias("kind"))
        rows = names.select("name", "kind", F.hash("name").alias("at"), F.regexp_count("name", F.lit(r"\.")).alias("dots")).limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"a suffix table has {MOST_RULES} rules at most")
        self.slots = max(1, len(rows) // 4)
        self.longest = max((r.dots + 1 for r in rows), default=0)
        slots: list[dict[str, int]] = [{} for _ in range(self.slots)]
        for r in rows:
            slots[r["at"] % self.slots][r["name"]] = r["kind"]
        self.table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")

    def of(self, host: Column) -> Column:
        """The longest suffix of a host; empty where no rule fits. A name that is left out of a wildcard decides, whatever else fits."""
        labels = F.regexp_count(host, F.lit(r"\.")) + 1

        def reach(n: Column) -> Column:
            """How many labels a rule for the last n makes a suffix; a thousand more for one that is left out."""
            name = F.call_function("substring_index", host, F.lit("."), -n)
            kind = F.coalesce(F.get(self.table, F.pmod(F.hash(name), F.lit(self.slots)))[name], F.lit(0))
            has = lambda k: kind.bitwiseAND(k) > 0
            return F.when(has(LEFT_OUT), 999 + n).when(has(WILD) & (labels > n), n + 1).when(has(PLAIN), n).otherwise(0)

        best = F.array_max(F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(max(self.longest, 1)))), reach))
        return F.get(F.transform(F.array(best), lambda n: F.when(n == 0, "").otherwise(F.call_function("substring_index", host, F.lit("."), -(n % 1000)))), F.lit(0))

    def split(self, host: Column) -> Column:
        """A host as a struct of is_ip, suffix, domain, subdomain, registered (domain and suffix, empty where one is) and checked (subdomain and domain)."""
        left = lambda text, less: F.left(text, F.greatest(F.length(text) - F.length(less) - 1, F.lit(0)))
        once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  names a value for what reads it often

        def parts(x: Column) -> Column:
            before = F.when(x["suffix"] == "", x["host"]).otherwise(left(x["host"], x["suffix"]))
            return once(F.struct(before.alias("before"), F.when(x["is_ip"], x["host"]).otherwise(F.substring_index(before, ".", -1)).alias("domain")), lambda y: whole(x, y))

        def whole(x: Column, y: Column) -> Column:
            subdomain = F.when(x["is_ip"], "").otherwise(left(y["before"], y["domain"]))
            registered = F.when((x["suffix"] != "") & (y["domain"] != ""), F.concat_ws(".", y["domain"], x["suffix"])).otherwise("")
            checked = F.when(subdomain != "", F.concat_ws(".", subdomain, y["domain"])).otherwise(y["domain"])
            return F.struct(x["is_ip"].alias("is_ip"), x["suffix"].alias("suffix"), y["domain"].alias("domain"), subdomain.alias("subdomain"), registered.alias("registered"), checked.alias("checked"))

        is_ip = host.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")
        return once(F.struct(host.alias("host"), is_ip.alias("is_ip"), F.when(is_ip, "").otherwise(self.of(host)).alias("suffix")), parts)

    def registered(self, host: Column) -> Column:
        """Registered domain of a host; empty where it has no known suffix or is an address."""
        return F.coalesce(self.split(host)["registered"], F.lit(""))


def with_host(urls: DataFrame, suffixes: Suffixes) -> DataFrame:
    """Adds text, authority, host and what `Suffixes.split` makes of it."""
    out = urls.withColumn("text", normalised(F.col("url")))
    out = out.withColumn("authority", F.regexp_replace(F.regexp_extract("text", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^.*@", ""))
    out = out.withColumn("host", F.lower(F.substring_index("authority", ":", 1)))
    out = out.withColumn("__parts", suffixes.split(F.col("host")))
    # a host is never null, and columns that say so draw no filters on themselves into the plan
    part = {k: F.coalesce(F.col("__parts")[k], F.lit("")) for k in ("suffix", "domain", "subdomain", "registered", "checked")}
    return out.withColumns({"is_ip": F.coalesce(F.col("__parts")["is_ip"], F.lit(False)), **part}).drop("__parts")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits, rounded to 4. A character is counted by what the text loses without it, so the text is split once."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.round(F.aggregate(F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), share), F.lit(0.0), lambda a, p: a - p * F.log2(p)), 4)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_in(text: Column, words: Sequence[str]) -> Column:
    """How many of the words are substrings; overlapping ones all count. One lambda over a literal list keeps the generated code small."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 4))


def longest(parts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(parts, lambda x: F.length(x))), F.lit(0))


def brand(checked: Column, tokens: Column) -> Column:
    """The first brand, in list order, that is a token, or a substring if it has six letters."""
    found = F.filter(F.array(*map(F.lit, D.BRANDS)), lambda b: F.array_contains(tokens, b) | ((F.length(b) >= TYPO_LENGTH) & F.contains(checked, b)))
    return F.get(found, F.lit(0))


def brand_distance(domain: Column) -> Column:
    """Letters between the domain and the nearest brand of six letters or more, FAR at most; short domains are far from all."""
    names = F.array(*(F.lit(b) for b in D.BRANDS if len(b) >= TYPO_LENGTH))
    near = F.filter(names, lambda b: F.abs(F.length(b) - F.length(domain)) < FAR)
    return F.when(F.length(domain) < 5, FAR).otherwise(F.least(F.lit(FAR), F.array_min(F.transform(near, lambda b: F.nullif(F.levenshtein(domain, b, FAR - 1), F.lit(-1))))))


def with_features(hosts: DataFrame) -> DataFrame:
    """The 31 lexical features; all read the host alone."""
    c = F.col
    t = c("checked")
    tokens = F.filter(F.split(t, r"[-_.0-9]+"), lambda x: x != "")
    official = F.create_map(*(F.lit(x) for pair in D.BRANDS.items() for x in pair))
    out = hosts.select("*", tokens.alias("tokens"))
    out = out.select(
        "*",
        F.length("host").alias("hostname_length"),
        F.length("domain").alias("domain_length"),
        F.length("suffix").alias("tld_length"),
        F.size(F.filter(F.split("subdomain", r"\."), lambda x: x != "")).alias("subdomain_count"),
        entropy(c("domain")).alias("domain_entropy"),
        entropy(c("host")).alias("hostname_entropy"),
        count_of(t, "[0-9]").alias("count_digit"),
        share(count_of(t, "[0-9]"), F.length(t)).alias("digit_ratio"),
        count_of(t, "-").alias("count_hyphen"),
        share(count_of(t, "-"), F.length(t)).alias("hyphen_ratio"),
        share(count_of(c("domain"), "[aeiou]"), count_of(c("domain"), r"\p{L}")).alias("vowel_ratio"),
        longest(F.regexp_extract_all("domain", F.lit(r"[^\P{L}aeiou]+"), F.lit(0))).alias("longest_consonant_run"),
        longest(F.regexp_extract_all("domain", F.lit(r"((.)\2*)"), F.lit(1))).alias("max_char_repeat"),
        F.greatest(F.size(F.regexp_extract_all(t, F.lit(r"\d+|\D+"), F.lit(0))) - 1, F.lit(0)).alias("digit_letter_transitions"),
        F.size("tokens").alias("token_count"),
        F.coalesce(F.round(F.aggregate("tokens", F.lit(0.0), lambda a, x: a + F.length(x)) / F.nullif(F.size("tokens"), F.lit(0)), 2), F.lit(0.0)).alias("avg_token_length"),
        longest(c("tokens")).alias("max_token_length"),
        c("is_ip").cast("int").alias("has_ip_address"),
        F.when(F.regexp_extract("authority", r":([0-9]+)$", 1).try_cast("int") <= 65535, 1).otherwise(0).alias("has_port"),
        F.contains(c("host"), F.lit("xn--")).cast("int").alias("has_punycode"),
        c("registered").isin(*D.SHORTENERS).cast("int").alias("is_shortener"),
        c("suffix").isin(*D.SUSPICIOUS_TLDS).cast("int").alias("suspicious_tld"),
        c("suffix").isin(*D.COMMON_TLDS).cast("int").alias("common_tld"),
        brand(t, c("tokens")).alias("brand"),
        brand_distance(c("domain")).alias("brand_edit_distance"),
        words_in(t, D.PHISHING_WORDS).alias("phishing_keyword_count"),
        words_in(t, D.GAMBLING_WORDS).alias("judol_keyword_count"),
        words_in(t, D.STRONG_GAMBLING_WORDS).alias("judol_strong_count"),
    )
    return out.select(
        "*",
        c("brand").isNotNull().cast("int").alias("contains_brand"),
        F.coalesce((official[c("brand")] != c("registered")).cast("int"), F.lit(0)).alias("brand_impersonation"),
        (c("phishing_keyword_count") > 0).cast("int").alias("has_phishing_keyword"),
        (c("judol_keyword_count") > 0).cast("int").alias("has_judol_keyword"),
    )
