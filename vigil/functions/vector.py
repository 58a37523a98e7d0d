"""The evidence of a site as 47 numbers for a model: unknown numbers are -1, unknown flags 0 next to a flag for `measured`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Countries with a column of their own.
COUNTRIES = ["US", "ID", "SG", "RU", "CN", "NL", "DE", "FR", "GB", "IN"]

#: Evidence columns read; those that a table lacks count as unknown.
EVIDENCE = {"age_days": "bigint", "country": "string", "ip": "string", "has_certificate": "boolean", "certificate_fits": "boolean", "certificate_days": "bigint", "status": "bigint", "hops": "bigint", "moved": "boolean", "readable": "boolean", "password": "boolean", "password_fields": "bigint", "forms": "bigint", "foreign_form": "boolean", "credential_words": "bigint", "gambling_words": "bigint", "strong_gambling_words": "bigint", "brand": "string", "hidden_frames": "bigint", "scrambled": "boolean", "page_bytes": "bigint", "title": "string"}


def vector() -> dict[str, Column]:
    """The columns in their fixed order."""
    c = F.col
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    number = lambda x, missing=-1: F.coalesce(c(x).cast("double"), F.lit(float(missing)))
    country = F.upper(F.coalesce("country", F.lit("")))
    filled = lambda x: F.coalesce(c(x), F.lit("")) != ""
    young, password = flag(c("age_days") <= 30), flag(c("password"))
    both = lambda a, b: ((a == 1) & (b == 1)).cast("int")
    brand, foreign, secured = flag(filled("brand")), flag(c("foreign_form")), flag(c("has_certificate"))
    return {
        "d_has_age": c("age_days").isNotNull().cast("int"), "d_age_days": number("age_days"), "d_age_to_7": flag(c("age_days") <= 7), "d_age_to_30": young, "d_age_to_180": flag(c("age_days") <= 180), "d_age_from_1095": flag(c("age_days") >= 1095),
        "d_has_country": flag(country != ""), **{f"d_country_{k}": flag(country == k) for k in COUNTRIES}, "d_country_other": flag((country != "") & ~country.isin(*COUNTRIES)), "d_has_ip": flag(filled("ip")),
        "d_certificate_checked": c("has_certificate").isNotNull().cast("int"), "d_has_certificate": secured, "d_certificate_fits": flag(c("certificate_fits")), "d_certificate_days": number("certificate_days"), "d_certificate_new": flag(c("certificate_days") <= 30),
        "d_opened": c("status").isNotNull().cast("int"), "d_status_200": flag(c("status") == 200), "d_status_4xx": flag(c("status").between(400, 499)), "d_hops": number("hops", 0), "d_moved": flag(c("moved")),
        "d_readable": flag(c("readable")), "d_password": password, "d_password_fields": number("password_fields", 0), "d_forms": number("forms", 0), "d_foreign_form": foreign,
        "d_credential_words": number("credential_words", 0), "d_gambling_words": number("gambling_words", 0), "d_strong_gambling_words": number("strong_gambling_words", 0), "d_brand": brand, "d_hidden_frames": number("hidden_frames", 0), "d_scrambled": flag(c("scrambled")),
        "d_page_kb": F.bround(number("page_bytes", 0) / 1024, 2), "d_title_length": F.length(F.coalesce("title", F.lit(""))), "d_has_title": flag(filled("title")),
        "d_password_and_young": both(password, young), "d_password_and_brand": both(password, brand), "d_password_no_certificate": ((password == 1) & (secured == 0)).cast("int"), "d_password_and_foreign_form": both(password, foreign),
    }


def names() -> list[str]:
    return list(vector())


def with_vector(evidence: DataFrame) -> DataFrame:
    missing = {k: F.lit(None).cast(t) for k, t in EVIDENCE.items() if k not in evidence.columns}
    return evidence.withColumns(missing).withColumns(vector()).drop(*missing)


SHOWN_LENGTH = 90
SUMMARY = {"age_days": "bigint", "created": "string", "owner_country": "string", "registrar": "string", "ip": "string", "hosting_country": "string", "provider": "string", "has_certificate": "boolean", "certificate_fits": "boolean", "certificate_issuer": "string", "status": "bigint", "hops": "bigint", "final_url": "string", "title": "string", "readable": "boolean", "password": "boolean", "forms": "bigint"}


def with_summary(evidence: DataFrame) -> DataFrame:
    """Adds summary: array<struct<name, value>> of the evidence that is there, soothing or not, in a fixed order, for display. Columns of SUMMARY that the table lacks count as unknown; what is unknown or empty is not shown."""
    given = {k: (F.col(k) if k in evidence.columns else F.lit(None)).cast(t) for k, t in SUMMARY.items()}
    text = lambda k: given[k].cast("string")
    years = F.format_string("%s days (~%.1f years)", given["age_days"], given["age_days"] / 365)
    issuer = F.coalesce(F.nullif(given["certificate_issuer"], F.lit("")), F.lit("a trusted party"))
    held = F.when(given["has_certificate"] & F.coalesce(given["certificate_fits"], F.lit(False)), F.concat(F.lit("valid, by "), issuer)).when(given["has_certificate"], "there, but another's").when(~given["has_certificate"], "none")
    lines = {
        "age": F.when(given["age_days"] >= 365, years).otherwise(F.concat(text("age_days"), F.lit(" days"))),
        **{k: text(k) for k in ("created", "owner_country", "registrar", "ip", "hosting_country", "provider")},
        "certificate": held,
        "status": text("status"),
        "redirects": F.when(given["hops"] > 0, text("hops")),
        "final_url": F.left(given["final_url"], F.lit(SHOWN_LENGTH)),
        "title": F.left(given["title"], F.lit(SHOWN_LENGTH)),
        "password_field": F.when(given["readable"], F.when(F.coalesce(given["password"], F.lit(False)), "yes").otherwise("no")),
        "forms": F.when(given["readable"], text("forms")),
    }
    listed = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in lines.items())), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return evidence.withColumn("summary", listed)
