"""E-mail rules, and the roll-up of link scores to their message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import mail as M
from vigil.functions import url as U
from vigil.operators import rules as R

PASSED_ON = 0.85


def email_rules() -> list[R.Rule]:
    """Rules over the columns of `with_email_features`."""
    c = F.col
    some = lambda x: F.size(x) > 0
    fake = c("impersonation").isNotNull()
    return [
        R.Rule("impersonation", fake, F.when(c("impersonation.free"), 0.95).otherwise(0.90), "The sender claims to be an institution but does not use its domain."),
        R.Rule("deceptive_link", some("deceptive"), 0.90, "A link shows one address and leads to another."),
        R.Rule("double_extension", some("double_files"), 0.95, "A file hides its kind behind a second extension."),
        R.Rule("dangerous_file", some("dangerous_files"), 0.90, "A file can run programs."),
        R.Rule("caution_file", some("caution_files"), 0.55, "A file can carry macros or other files."),
        R.Rule("reply_to", c("reply_to_differs"), 0.65, "Replies go to another domain."),
        R.Rule("return_path", c("return_path_differs") & ~c("reply_to_differs"), 0.45, "The return path names another domain."),
        R.Rule("secrets", some("secrets"), F.when(some("links"), 0.85).otherwise(0.60), "The message asks for secrets."),
        R.Rule("urgency", some("urgent"), F.when(F.size("urgent") >= 2, 0.55).otherwise(0.30), "The message presses for haste."),
        R.Rule("prizes", F.size("prizes") >= 2, 0.60, "The message promises prizes."),
        R.Rule("free_mail_with_links", c("free_mail") & ~fake & some("links"), 0.35, "A free mail account sends links."),
    ]


def with_rules(features: DataFrame) -> DataFrame:
    return features.withColumn("rules", R.fired(email_rules())).withColumn("rule_score", R.strongest("rules"))


def worst_links(emails: DataFrame, allowed: DataFrame, suffixes: U.Suffixes, id: str = "id", first: int | None = None) -> DataFrame:
    """One row for each message with links: n_scored and its worst link (url, score, label; the first of equals; null if all score 0).

    All links are scored, or the first ones of a message if `first` says how many. Only the
    id and the links travel; link scores are combined before the shuffle.
    """
    links = F.col("links") if first is None else F.slice("links", 1, first)
    each = emails.select(F.col(id).alias("__id"), F.posexplode(links).alias("__at", "url"))
    scored = R.fused(U.with_features(U.with_host(each, suffixes)), F.lit(0.0), allowed)
    worst = F.max_by(F.struct(F.col("url"), F.col("risk_score").alias("score"), F.col("threat_label").alias("label")), F.struct("risk_score", -F.col("__at")))
    return scored.groupBy(F.col("__id").alias(id)).agg(F.count("*").alias("n_scored"), worst.alias("worst")).withColumn("worst", F.when(F.col("worst.score") > 0, F.col("worst")))


def scored(features: DataFrame, allowed: DataFrame, suffixes: U.Suffixes, id: str = "id", first: int | None = None) -> DataFrame:
    """Adds rules, n_scored, worst link, risk score, label and explanations. Ids are unique."""
    ruled = with_rules(features).join(worst_links(features, allowed, suffixes, id, first), id, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    passed = F.coalesce(F.col("worst.score"), F.lit(0.0)) * PASSED_ON
    out = ruled.withColumn("risk_score", F.round(F.least(F.greatest(F.col("rule_score"), passed, F.lit(0.0)), F.lit(1.0)), 4))
    note = lambda when, title, reason, weight: F.when(when, F.struct(F.lit(title).alias("title"), F.lit(reason).alias("reason"), weight.alias("weight")))
    bad_link = F.coalesce(F.col("worst.score") >= R.SUSPICIOUS, F.lit(False))
    notes = F.array(
        note(bad_link, "bad_link", "A link in the message is rated as a threat.", F.round(passed, 3)),
        note((F.size("rules") == 0) & ~bad_link, "nothing_found", "No rule fired and the links look ordinary.", F.lit(0.0)),
        note(~F.coalesce("has_header", F.lit(False)), "no_headers", "The sender could not be checked.", F.lit(0.0)),
    )
    return out.withColumns({"threat_label": R.label(F.col("risk_score")), "explanations": F.concat(R.explained("rules"), F.filter(notes, lambda x: x.isNotNull()))})


def scan(emails: DataFrame, allowed: DataFrame, suffixes: U.Suffixes, raw: str = "raw", id: str = "id") -> DataFrame:
    """From raw messages to scores; rejected ones (empty, too long) are left out."""
    return scored(M.with_email_features(M.parsed(emails.where(M.reject_reason(F.col(raw)).isNull()), raw)), allowed, suffixes, id)
