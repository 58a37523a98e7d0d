"""Page evidence from HTML, and the rules over evidence, as Column expressions.

A page is read as a stream of tokens: comments, whole scripts and styles, declarations,
tags and text. One pattern cuts the page, one pass marks what each token is, and all
counts come from the marks: so nothing inside a comment, a script or an attribute is
taken for a tag. Quotes protect `>` only after `=`, as parsers have it; a tag of more
than 500 attributes is text. Comments, scripts and styles that do not end run to the end
of the page. Entities are decoded once, numeric and named, in text and in attributes.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import dictionaries as D
from vigil.functions import links as L
from vigil.functions import url as U
from vigil.operators.rules import Rule

# Words that ask for credentials; patterns of scrambled scripts.
CREDENTIAL_WORDS = ["password", "kata sandi", "katasandi", "sandi", "pin", "otp", "verifikasi", "verification", "login", "masuk", "sign in", "username", "nama pengguna", "no rekening", "nomor rekening", "cvv", "atm", "mpin", "token"]
SCRAMBLED = [r"(?i)eval\s*\(\s*(atob|unescape|decodeURIComponent)", r"(?i)document\.write\s*\(\s*unescape", r"(?i)fromCharCode\s*\((\s*[0-9]+\s*,){12}", r"(?i)\\x[0-9a-f]{2}(\\x[0-9a-f]{2}){25}"]
INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["']){0,1000}+"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]){INSIDE}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*+>?|\z)|<[!?][^>]*+>?|</[^>]*+>|<[a-z][^\s/>]*+{INSIDE}>|[^<]++|<"
ATTRIBUTE = r"""(?s)(?<=['"\s/])[^\s/>][^\s/=>]*+(?:\s*+=+\s*+(?:'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+))?"""
LONGEST_TEXT = 200_000
BLANK, UNBLANK = r"[\s\x1c-\x1f\x85\p{Z}]", r"[^\s\x1c-\x1f\x85\p{Z}]"
# what a token is, in the text of marks: a cut, the begin and end of an element whose text is not shown, of a title
CUT, SHUT, OPENED, TITLE, TITLED = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
UNSHOWN = r"(?i)^</?(template|rt|rp)[\s/>]"
BRAND = rf"(?<![a-z0-9])(?:{'|'.join(D.BRANDS)})(?![a-z0-9])"
MATURE_DAYS, YOUNG_DAYS, FRESH_DAYS, LEAST_WEIGHT = 730, 30, 7, 0.15


def _code_points() -> dict[str, str]:
    """Numbers 128 to 159 mean the characters of the Windows code page."""
    return {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}


def _named() -> dict[str, dict[str, str]]:
    """The named entities of HTML by their first two letters."""
    out: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        if name.endswith(";"):
            out.setdefault(name[:2], {})[name[:-1]] = text
    return out


def _character(number: Column) -> Column:
    """The character of a number; a replacement character where there is none."""
    windows = F.from_json(F.lit(json.dumps(_code_points())), "map<string,string>")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(number.between(128, 159), windows[number.cast("string")]).when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")


def decoded(text: Column) -> Column:
    """The text with entities decoded, each once. An unknown name stays, without its semicolon."""
    named = F.from_json(F.lit(json.dumps(_named())), "map<string,map<string,string>>")

    def one(part: Column) -> Column:
        name = F.regexp_replace(part, "^&|;$", "")
        number = F.when(part.rlike("^&#[xX]"), F.conv(F.left(F.regexp_extract(part, "^&#[xX]0*([0-9a-fA-F]*)", 1), F.lit(8)), 16, 10)).otherwise(F.left(F.regexp_extract(part, "^&#0*([0-9]*)", 1), F.lit(10))).try_cast("long")
        return F.when(~F.startswith(part, F.lit("&")) | (F.length(part) == 1), part).when(F.startswith(part, F.lit("&#")), _character(F.coalesce(number, F.lit(0).cast("long")))).otherwise(F.coalesce(named[F.left(name, F.lit(2))][name], F.concat(F.lit("&"), name)))

    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][-.a-zA-Z0-9]*+;?|[^&]++|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def stripped(text: Column) -> Column:
    """The text up to its last character that is no blank, looked for from the end: blanks within it cost nothing."""
    return F.regexp_extract(text, rf"(?s)\A{BLANK}*+(.*{UNBLANK})?", 1)


def _mark(token: Column) -> Column:
    """Text as it is, and what every other token is as one character."""
    unshown = token.rlike(UNSHOWN)
    return (
        F.when(~F.startswith(token, F.lit("<")) | (token == "<"), F.translate(token, CUT + SHUT + OPENED + TITLE + TITLED, "�" * 5))
        .when(unshown & ~F.startswith(token, F.lit("</")) & ~F.endswith(token, F.lit("/>")), OPENED)
        .when(unshown & F.startswith(token, F.lit("</")), SHUT)
        .when(token.rlike(r"(?i)^<title[\s/>]"), TITLE)
        .when(token.rlike(r"(?i)^</title[\s/>]"), TITLED)
        .otherwise(CUT)
    )


def with_tokens(pages: DataFrame) -> DataFrame:
    """Adds __tokens and __marked of html; null html counts as an empty page."""
    out = pages.withColumn("__tokens", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), F.lit(0)))
    return out.withColumn("__marked", F.array_join(F.transform("__tokens", _mark), ""))


def visible() -> Column:
    """The text shown: pieces between tags, stripped and joined by one blank, in lower case."""
    text = F.col("__marked")
    for _ in range(4):  # elements without shown text within such elements
        text = F.regexp_replace(text, f"{OPENED}[^{OPENED}{SHUT}]*+{SHUT}", CUT)
    text = F.regexp_replace(text, rf"{OPENED}[^{SHUT}]*+\z", CUT)
    pieces = F.filter(F.transform(F.split(text, f"[{CUT}-{TITLED}]"), lambda x: stripped(decoded(x))), lambda x: x != "")
    return F.lower(F.array_join(pieces, " "))


def title() -> Column:
    """The text of the first title, if it holds nothing but text."""
    found = F.regexp_extract("__marked", rf"(?s)^[^{TITLE}]*+{TITLE}([^{CUT}-{TITLED}]*+)(?:{TITLED}|\z)", 1)
    return stripped(decoded(found))


def scripts() -> Column:
    """The text of all scripts."""
    own = F.filter("__tokens", lambda t: t.rlike(r"(?i)^<script[\s/>]"))
    inner = F.transform(own, lambda t: F.regexp_replace(F.regexp_replace(t, rf"(?is)^<script{INSIDE}>", ""), r"(?is)</script[\s/>][^>]*+>?\z", ""))
    return F.array_join(inner, " ")


def tags(name: str) -> Column:
    """The start tags of a name."""
    return F.filter("__tokens", lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of an attribute of a tag, the last one if it is given twice; empty if it has no value, null if it is not there."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?is)^{name}(\s*=.*)?\z"))
    value = F.regexp_replace(F.regexp_replace(F.element_at(own, -1), r"(?s)^[^\s=]*+\s*+=*+\s*+", ""), r"""(?s)^(["'])(.*)\1\z""", "$2")
    return F.when(F.size(own) > 0, decoded(value))


def _hidden(frame: Column) -> Column:
    style = F.replace(F.lower(F.coalesce(attribute(frame, "style"), F.lit(""))), F.lit(" "), F.lit(""))
    width = stripped(F.coalesce(attribute(frame, "width"), F.lit("")))
    return F.contains(style, F.lit("display:none")) | F.contains(style, F.lit("visibility:hidden")) | attribute(frame, "hidden").isNotNull() | width.isin("0", "0px")


def with_page_features(pages: DataFrame, longest: int | None = LONGEST_TEXT) -> DataFrame:
    """pages: html. Adds title, password_fields, forms, hidden_frames, scrambled, credential_words, gambling_words and strong_gambling_words.

    Words are looked for in the first `longest` characters of the text shown; None: in all of it.
    """
    text = visible() if longest is None else F.left(visible(), F.lit(longest))
    out = with_tokens(pages).withColumns({"__text": text, "__scripts": scripts()})
    words = lambda xs: U.words_in(F.col("__text"), xs)
    scrambled = F.lit(False)
    for p in SCRAMBLED:
        scrambled = scrambled | F.col("__scripts").rlike(p)
    return out.select(
        "*",
        title().alias("title"),
        F.size(F.filter(tags("input"), lambda t: F.coalesce(attribute(t, "type"), F.lit("")).rlike(r"(?i)^password\n?\z"))).alias("password_fields"),
        F.size(tags("form")).alias("forms"),
        F.size(F.filter(tags("iframe"), _hidden)).alias("hidden_frames"),
        scrambled.alias("scrambled"),
        words(CREDENTIAL_WORDS).alias("credential_words"),
        words(D.GAMBLING_WORDS).alias("gambling_words"),
        words(D.STRONG_GAMBLING_WORDS).alias("strong_gambling_words"),
    ).drop("__tokens", "__marked", "__text", "__scripts")


def with_site_features(pages: DataFrame, suffixes: U.Suffixes) -> DataFrame:
    """pages: url, html. Adds foreign_target (the first form target on another registered domain, else null), foreign_form, and brand (the first brand named as a whole word whose own domain is not the page's, else null). Addresses and hosts without a known suffix have no registered domain: they neither send to another one nor are one. Nulls count as empty."""
    own = suffixes.registered(L.host_of(U.normalised(F.col("url"))))
    out = with_tokens(pages).withColumns({"__own": own, "__text": visible()})
    aims = F.filter(F.transform(tags("form"), lambda t: stripped(F.coalesce(attribute(t, "action"), F.lit("")))), lambda a: a.rlike("^https?://"))
    targets = F.transform(aims, lambda x: suffixes.registered(L.host_of(x)))
    # one pass over the text finds all brands; the first in list order counts
    out = out.withColumn("__named", F.regexp_extract_all("__text", F.lit(BRAND), F.lit(0)))
    named = F.coalesce(*(F.when(F.array_contains("__named", b) & (F.col("__own") != official), b) for b, official in D.BRANDS.items()))
    out = out.withColumns({"foreign_target": F.get(F.filter(targets, lambda x: (x != "") & (F.col("__own") != "") & (x != F.col("__own"))), F.lit(0)), "brand": named})
    return out.withColumn("foreign_form", F.col("foreign_target").isNotNull()).drop("__own", "__tokens", "__marked", "__text", "__named")


def damping(age: Column) -> Column:
    """Long-standing domains weaken what is read off a page; an unknown age does not."""
    return F.when(age >= 3 * MATURE_DAYS, 0.25).when(age >= MATURE_DAYS, 0.5).otherwise(1.0)


def evidence_rules() -> list[Rule]:
    """Rules over evidence columns; null means not measured and never fires a rule that needs the value."""
    c = F.col
    password = F.coalesce("password", F.lit(False))
    age, damp = c("age_days"), damping(F.col("age_days"))
    known = lambda x: F.coalesce(x, F.lit(False))
    strong, words = F.coalesce("strong_gambling_words", F.lit(0)), F.coalesce("gambling_words", F.lit(0))
    frames, asks = F.coalesce("hidden_frames", F.lit(0)), F.coalesce("credential_words", F.lit(0))
    brand = c("brand").isNotNull()
    damped = lambda when, weight: (when & (F.round(weight * damp, 3) >= LEAST_WEIGHT), F.round(weight * damp, 3))
    brand_when, brand_weight = damped(password & brand, F.lit(0.95))
    script_when, script_weight = damped(known(c("scrambled")), F.when(password, 0.70).otherwise(0.35))
    frame_when, frame_weight = damped(frames > 0, F.when(password, 0.70).when(frames >= 3, 0.50).otherwise(0.20))
    return [
        Rule("page_gambling", (strong >= 1) | (words >= 4), F.when((strong >= 3) | (words >= 8), 0.95).otherwise(0.80), "The page offers gambling."),
        Rule("password_and_brand", brand_when, brand_weight, "A password is asked for under another's brand."),
        Rule("password_on_young_domain", password & ~brand & known(age <= YOUNG_DAYS), 0.90, "A new domain asks for a password."),
        Rule("foreign_form", known(c("foreign_form")), F.when(password, 0.90).otherwise(0.70), "What is typed goes elsewhere."),
        Rule("young_domain", ~password & known(age <= YOUNG_DAYS), F.when(age <= FRESH_DAYS, 0.50).otherwise(0.40), "The domain is new."),
        Rule("moved", known(c("moved")), 0.55, "The address leads to another site."),
        Rule("certificate", known(c("has_certificate") & ~c("certificate_fits")), 0.60, "The certificate is another's."),
        Rule("no_certificate", known(~c("has_certificate")) & password, 0.75, "A password is asked for without encryption."),
        Rule("scrambled_script", script_when, script_weight, "Scripts are scrambled."),
        Rule("hidden_frame", frame_when, frame_weight, "Frames are hidden."),
        Rule("asks_for_secrets", (asks >= 4) & ~password, 0.45, "The page speaks of secrets a lot."),
    ]


def deep_weight(probability: Column, readable: Column) -> Column:
    """What the evidence model adds, where the page could be read."""
    return F.when(F.coalesce(readable, F.lit(False)), F.when(probability >= 0.90, 0.85).when(probability >= 0.75, 0.60).when(probability >= 0.60, 0.45)).otherwise(0.0)
