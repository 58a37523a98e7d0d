"""Declarative weighted rules, compiled into one projection, and the fusion of their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import dictionaries as D

MALICIOUS, SUSPICIOUS = 0.70, 0.40

REASONS = {
    "gambling": "The host names gambling.",
    "brand_impersonation": "A brand is named outside its own domain.",
    "typosquatting": "The name is a letter or two away from a brand.",
    "raw_ip": "The host is a bare address.",
    "punycode": "The host holds look-alike letters.",
    "cheap_tld": "The suffix is one that costs next to nothing.",
    "free_hosting": "The page sits on a free hosting platform.",
    "fake_suffix": "A familiar suffix stands before the real one.",
    "path_word": "The path asks for a sign-in.",
    "shortener": "The link hides its target.",
    "port": "A port is given.",
}


@dataclass(frozen=True)
class Rule:
    """`when` decides, `weight` is a number or a Column; rules fire in the order of their list."""

    name: str
    when: Column
    weight: Column | float
    reason: str


def fired(rules: list[Rule]) -> Column:
    """array<struct<ord, weight, name, reason>> of the rules that fire, in evaluation order."""
    made = [F.when(r.when, F.struct(F.lit(k).alias("ord"), (r.weight if isinstance(r.weight, Column) else F.lit(r.weight)).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.reason).alias("reason"))) for k, r in enumerate(rules)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def strongest(column: str) -> Column:
    return F.coalesce(F.array_max(F.transform(column, lambda x: x["weight"])), F.lit(0.0))


def explained(column: str) -> Column:
    """Rules by falling weight; equal weights keep their order."""
    keyed = F.transform(column, lambda x: F.struct((-x["weight"]).alias("w"), x["ord"].alias("o"), x["name"].alias("name"), x["reason"].alias("reason")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["name"].alias("title"), x["reason"].alias("reason"), (-x["w"]).alias("weight")))


NOTES = {
    "popular": "The domain is among the most visited ones; it was hardly registered to deceive.",
    "popular_but_flagged": "The domain is popular, but a firm rule fired, and popularity does not undo that.",
    "evidence_model": "Weighing all evidence at once, the model finds the address risky.",
    "unusual_name": "No firm rule is broken, but the model finds the name unusual; a weak sign.",
    "nothing_found": "No rule is broken and the name looks ordinary.",
    "failed_checks": "Some checks failed; the result rests on the others.",
    "empty_file": "There is no content to check.",
    "clean_file": "The content fits the name and carries no macro or program.",
}


def noted(*notes: tuple[str, Column, Column]) -> Column:
    """Notes (name, condition, weight) that hold, in the order given, with the fields of `explained`."""
    each = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(n).alias("title"), F.lit(NOTES[n]).alias("reason"), weight.cast("double").alias("weight"))) for n, when, weight in notes]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def url_notes(ml_score: Column, deep_score: Column | None = None, failures: Column | None = None) -> Column:
    """What is said beside the rules of a fused row: allow-list, evidence model, what there is to say without a rule, failed checks. Unknown scores say nothing."""
    c, zero = F.col, F.lit(0.0)
    deep = F.lit(None).cast("double") if deep_score is None else deep_score
    none, unusual = F.size("rules") == 0, F.coalesce(ml_score >= 0.6, F.lit(False))
    return noted(
        ("popular", c("allowlisted") & (c("rule_score") < SUSPICIOUS), zero),
        ("popular_but_flagged", c("allowlisted") & (c("rule_score") >= SUSPICIOUS), zero),
        ("evidence_model", deep >= 0.60, F.round(deep, 3)),
        ("unusual_name", none & unusual, F.round(ml_score, 3)),
        ("nothing_found", none & ~unusual & ~c("allowlisted"), zero),
        ("failed_checks", F.lit(False) if failures is None else F.size(failures) > 0, zero),
    )


def file_notes() -> Column:
    """What is said of a file beside its rules."""
    empty = F.col("kind") == "empty"
    return noted(("empty_file", empty, F.lit(0.0)), ("clean_file", ~empty & (F.size("rules") == 0), F.lit(0.0)))


def label(score: Column) -> Column:
    return F.when(score >= MALICIOUS, "Malicious").when(score >= SUSPICIOUS, "Suspicious").otherwise("Safe")


def url_rules() -> list[Rule]:
    """Rules over the columns of `with_features`."""
    c = F.col
    hosted = c("registered").isin(*D.FREE_HOSTING) & ~c("subdomain").isin("", "www")
    lowered = F.lower(c("text"))
    tail = F.substring_index(lowered, "//", -1)
    path = F.when(F.contains(tail, F.lit("/")), F.regexp_extract(tail, r"(?s)^[^/]*(/.*)$", 1)).otherwise("")
    path_word = F.coalesce(*(F.when(F.contains(path, F.lit(w)), w) for w in D.PATH_WORDS)).isNotNull()
    inner = F.substring_index(F.col("checked"), ".", -1)
    fake = inner.isin(*D.FAKE_INNER_SUFFIXES) & (c("suffix") != "") & (c("suffix") != inner)
    cheap, words = c("suspicious_tld") == 1, c("has_phishing_keyword") == 1
    strong, total = c("judol_strong_count"), c("judol_keyword_count")
    return [
        Rule("gambling", (strong >= 1) | (total >= 2), F.when(strong >= 2, 0.95).when(strong == 1, 0.85).otherwise(0.70), REASONS["gambling"]),
        Rule("brand_impersonation", c("brand_impersonation") == 1, 0.90, REASONS["brand_impersonation"]),
        Rule("typosquatting", c("brand_edit_distance").between(1, 2) & (c("brand_impersonation") == 0), 0.85, REASONS["typosquatting"]),
        Rule("raw_ip", c("has_ip_address") == 1, 0.85, REASONS["raw_ip"]),
        Rule("punycode", c("has_punycode") == 1, 0.85, REASONS["punycode"]),
        Rule("cheap_tld", cheap, F.when(words, 0.75).otherwise(0.30), REASONS["cheap_tld"]),
        Rule("free_hosting", hosted, F.when(path_word | words, 0.80).otherwise(0.55), REASONS["free_hosting"]),
        Rule("fake_suffix", fake, 0.85, REASONS["fake_suffix"]),
        Rule("path_word", path_word & ~hosted, 0.50, REASONS["path_word"]),
        Rule("shortener", c("is_shortener") == 1, 0.50, REASONS["shortener"]),
        Rule("port", c("has_port") == 1, 0.40, REASONS["port"]),
    ]


def fused(features: DataFrame, ml_score: Column, allowed: DataFrame) -> DataFrame:
    """Adds rules, score and label. allowed: column registered, a table of its own; one shuffle join or, where it is small, a broadcast by Spark's own size check."""
    member = allowed.select("registered").distinct().withColumn("allowlisted", F.lit(True))
    out = features.withColumn("rules", fired(url_rules())).join(member, "registered", "left").withColumn("allowlisted", F.coalesce("allowlisted", F.lit(False)))
    model = F.when(ml_score >= 0.95, 0.75).when(ml_score >= 0.90, 0.55).otherwise(0.0)
    out = out.withColumn("rule_score", strongest("rules"))
    raw = F.greatest(F.col("rule_score"), model)
    damped = F.when(F.col("allowlisted") & (F.col("rule_score") < SUSPICIOUS), F.least(raw, F.lit(0.15))).otherwise(raw)
    out = out.withColumn("risk_score", F.round(F.least(F.greatest(damped, F.lit(0.0)), F.lit(1.0)), 4))
    return out.withColumn("threat_label", label(F.col("risk_score")))
