"""E-mail parsing and features. Only the MIME structure is read in Python; every feature is a Column expression."""

from __future__ import annotations

import re
from email import message_from_string
from email.utils import getaddresses, parseaddr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that press, words that ask for secrets, words that promise; file extensions; free mail hosts; institutions and their own domains.
URGENT_WORDS = ["segera", "mendesak", "penting", "batas waktu", "kedaluwarsa", "diblokir", "dibekukan", "ditangguhkan", "terakhir", "sekarang juga", "dalam 24 jam", "akan dihapus", "akan ditutup", "verifikasi sekarang", "konfirmasi sekarang", "jangan abaikan", "peringatan terakhir", "urgent", "immediately", "expire", "expired", "suspended", "locked", "deadline", "final notice", "act now", "within 24 hours", "verify now", "confirm now", "last warning", "account closure"]
SECRET_WORDS = ["kata sandi", "sandi", "pin", "otp", "kode otp", "kode verifikasi", "nomor rekening", "nomor kartu", "cvv", "kode cvv", "m-pin", "data pribadi", "nik", "ktp", "mother maiden", "password", "credential", "card number", "account number", "social security", "security code", "one time password"]
PRIZE_WORDS = ["selamat anda", "anda terpilih", "hadiah", "undian", "menang", "gratis", "bonus", "cashback", "saldo", "voucher", "klaim", "congratulations", "you won", "prize", "claim your", "free gift"]
DANGEROUS_EXTENSIONS = ["exe", "scr", "com", "pif", "bat", "cmd", "vbs", "vbe", "js", "jse", "wsf", "wsh", "msi", "msc", "jar", "ps1", "hta", "cpl", "reg", "lnk", "iso", "img", "apk"]
CAUTION_EXTENSIONS = ["docm", "xlsm", "pptm", "dotm", "xltm", "xlam", "zip", "rar", "7z"]
FREE_MAIL = ["gmail.com", "yahoo.com", "yahoo.co.id", "hotmail.com", "outlook.com", "outlook.co.id", "aol.com", "mail.com", "gmx.com", "yandex.com", "protonmail.com", "zoho.com", "rocketmail.com", "live.com"]
INSTITUTIONS = {
    "bri": ["bri.co.id", "bankbri.co.id"], "bca": ["bca.co.id", "klikbca.com"], "mandiri": ["bankmandiri.co.id"], "bni": ["bni.co.id"], "bsi": ["bankbsi.co.id"],
    "btn": ["btn.co.id"], "cimb": ["cimbniaga.co.id"], "permata": ["permatabank.com"], "danamon": ["danamon.co.id"], "ovo": ["ovo.id"], "gopay": ["gopay.co.id", "gojek.com"],
    "dana": ["dana.id"], "shopee": ["shopee.co.id", "shopee.com"], "tokopedia": ["tokopedia.com"], "bukalapak": ["bukalapak.com"], "lazada": ["lazada.co.id"], "grab": ["grab.com"],
    "gojek": ["gojek.com"], "telkomsel": ["telkomsel.com", "telkomsel.co.id"], "indihome": ["indihome.co.id", "telkom.co.id"], "pln": ["pln.co.id"],
    "bpjs": ["bpjs-kesehatan.go.id", "bpjsketenagakerjaan.go.id"], "pajak": ["pajak.go.id"], "prakerja": ["prakerja.go.id"], "paypal": ["paypal.com"], "netflix": ["netflix.com"],
    "microsoft": ["microsoft.com", "outlook.com"], "google": ["google.com", "gmail.com"], "apple": ["apple.com", "icloud.com"], "whatsapp": ["whatsapp.com"], "instagram": ["instagram.com"],
    "facebook": ["facebook.com", "fb.com"],
}
# Patterns of header lines, links, anchors, tags, shown and target hosts and double extensions; what is cut off behind a link.
HEADER = r"^(from|dari|subject|subjek|to)\s*:"
LINK = r"(?i)https?://[^\s<>\"'\)\]]+"
ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
TAG = r"<[^>]+>"
SHOWN_HOST = r"(?i)([a-z0-9-]+(?:\.[a-z0-9-]+)+)"
TARGET_HOST = r"(?i)https?://([^/\s:?]+)"
LINK_TAIL = ".,;:!?)\"'"
DOUBLE_EXTENSION = r"\.(pdf|doc|docx|xls|xlsx|jpg|png|txt)\.[a-z0-9]{2,4}$"
ATTACHMENT_CUE = r"lampir|terlampir|attach|filename|dokumen|berkas|unduh|download"
HTML_MARK = r"(?i)<(a|div|table|body|html)\b"
CUE_BEFORE, CUE_AFTER = 120, 40
LONGEST_MAIL = 1_000_000

# A name ends at the last dot with an extension in its run of name characters, so one anchored try for each run finds the same names as a search at every character.
FILE_NAME = r"(?U)(?<![\w\-. ])[\w\-. ]+\.[a-zA-Z0-9]{2,5}"
ADDRESS = r"(?U)(?<![\w.-])[\w.-]++@[\w.-]+"

# what a worker holds at once: so many messages, of so many bytes together (one message at least)
BATCH = {"maxRecordsPerBatch": "500", "maxBytesPerBatch": "4m"}
PARTS = "has_header boolean, from_name string, from_addr string, reply_to string, return_path string, subject string, body string, attachments array<string>"


def parts_of(raw: str) -> tuple:
    """One message as the fields of PARTS; text without headers is all body, and so is what cannot be parsed."""
    plain = (bool(re.search(HEADER, raw, re.I | re.M)), "", "", "", "", "", raw, [])
    if not plain[0]:
        return plain
    try:
        message = message_from_string(raw)
        name, sender = parseaddr(str(message.get("From") or message.get("Dari") or ""))
        replies = getaddresses([str(x) for x in message.get_all("Reply-To", [])])
        returns = parseaddr(str(message.get("Return-Path") or ""))[1]
        subject = str(message.get("Subject") or message.get("Subjek") or "")
    except Exception:  # malformed headers: the message counts as plain text
        return plain
    bodies, files = [], []
    for part in message.walk() if message.is_multipart() else [message]:
        if message.is_multipart():
            if name_of := part.get_filename():
                files.append(name_of)
                continue
            if part.get_content_type() not in ("text/plain", "text/html"):
                continue
        bodies.append(_decoded(part))
    return (True, name.strip(), sender.strip().lower(), replies[0][1].strip().lower() if replies else "", returns.strip().lower(), subject.strip(), "\n".join(bodies) if bodies else raw, files)


def _decoded(part) -> str:
    """The text of one part in its own charset; an unknown charset or a broken encoding leaves it as sent."""
    try:
        return (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
    except Exception:
        return str(part.get_payload())


def _storable(x):
    """Lone surrogates, which Arrow cannot hold, become question marks."""
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else [_storable(y) for y in x] if isinstance(x, list) else x


def parsed(emails: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the columns of PARTS. Null counts as an empty text."""
    for key, value in BATCH.items():
        emails.sparkSession.conf.set(f"spark.sql.execution.arrow.{key}", value)
    names = [x.split()[0] for x in PARTS.split(", ")]

    @F.arrow_udf(PARTS)
    def split(texts: pa.Array) -> pa.Array:
        columns = [[] for _ in names]
        for text in texts.to_pylist():
            for column, value in zip(columns, parts_of(text or ""), strict=True):
                column.append(_storable(value))
        kinds = [pa.bool_(), *[pa.string()] * (len(names) - 2), pa.list_(pa.string())]
        return pa.StructArray.from_arrays(list(map(pa.array, columns, kinds)), names)

    return emails.withColumn("__parts", split(F.coalesce(F.col(raw), F.lit("")))).select(*emails.columns, "__parts.*")


def reject_reason(raw: Column) -> Column:
    n = F.length(F.coalesce(raw, F.lit("")))
    return F.when(n < 1, "empty").when(n > LONGEST_MAIL, "too long")


def domain_of(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("@")), F.trim(F.lower(F.trim(F.substring_index(address, "@", -1))), F.lit(">"))).otherwise("")


def found(text: Column, words: list[str]) -> Column:
    """The words that occur, in list order; a word inside another counts too."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def links(body: Column) -> Column:
    """Bare links, then link targets, without closing punctuation; the first of equal ones stays."""
    targets = F.filter(F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1)), lambda x: F.startswith(F.lower(x), F.lit("http")))
    return F.array_distinct(F.transform(F.concat(F.regexp_extract_all(body, F.lit(LINK), F.lit(0)), targets), lambda x: F.rtrim(x, F.lit(LINK_TAIL))))


def _below(a: Column, b: Column) -> Column:
    return F.endswith(a, F.concat(F.lit("."), b))


def deceptive(body: Column) -> Column:
    """Anchors that show one host and lead to another, neither above the other. Leading letters w and dots do not count."""
    bare = lambda x: F.ltrim(F.lower(x), F.lit("w."))
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1)).alias("url"), F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(2)).alias("label"))
    shown = F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), F.regexp_extract(F.trim(F.regexp_replace(p["label"], TAG, " ")), SHOWN_HOST, 1).alias("seen"), bare(F.regexp_extract(p["url"], TARGET_HOST, 1)).alias("target")))
    kept = F.filter(shown, lambda x: (x["seen"] != "") & (x["target"] != ""))
    named = F.transform(kept, lambda x: F.struct(bare(x["seen"]).alias("shown"), x["target"].alias("target"), x["url"].alias("url")))
    return F.filter(named, lambda x: (x["shown"] != x["target"]) & ~_below(x["shown"], x["target"]) & ~_below(x["target"], x["shown"]))


def impersonated(name: Column, subject: Column, domain: Column) -> Column:
    """struct<institution, used, official, free> of the first institution named as a whole word, unless the sender's domain is its own; else null."""
    hint = F.lower(F.concat(name, F.lit(" "), subject))
    first = F.coalesce(*(F.when(hint.rlike(rf"(?U)\b{re.escape(k)}\b"), F.struct(F.lit(k).alias("institution"), F.array(*map(F.lit, own)).alias("own"))) for k, own in INSTITUTIONS.items()))
    foreign = ~F.exists(first["own"], lambda d: (domain == d) | _below(domain, d))
    return F.when((domain != "") & foreign, F.struct(first["institution"].alias("institution"), domain.alias("used"), F.element_at(first["own"], 1).alias("official"), domain.isin(*FREE_MAIL).alias("free")))


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def named_files(text: Column) -> Column:
    """Files that the text speaks of: with two extensions, or with one of concern near a word for attachments."""
    lowered = F.lower(text)

    def fits(name: Column) -> Column:
        low = F.lower(name)
        at = F.instr(lowered, low) - 1
        start = F.greatest(at - CUE_BEFORE, F.lit(0))
        near = F.substring(lowered, start + 1, at + CUE_AFTER - start)
        return low.rlike(DOUBLE_EXTENSION) | (extension(low).isin(*DANGEROUS_EXTENSIONS, *CAUTION_EXTENSIONS) & near.rlike(ATTACHMENT_CUE))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(FILE_NAME), F.lit(0)), lambda x: F.trim(x)), fits)


def with_email_features(emails: DataFrame) -> DataFrame:
    """Adds the features of a message to the columns of PARTS; nulls count as empty.

    Steps are separate so that stripped texts and arrays are computed once each.
    """
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit(""))
    out = emails.withColumns({x: text(x) for x in ("from_name", "from_addr", "reply_to", "return_path", "subject", "body")})
    out = out.withColumn("attachments", F.coalesce("attachments", F.array().cast("array<string>")))
    out = out.withColumn("__whole", F.concat("subject", F.lit("\n"), "body")).withColumn("__clean", F.regexp_replace("__whole", TAG, " "))
    out = out.withColumn("__unlinked", F.regexp_replace(F.regexp_replace("__whole", LINK, " "), ADDRESS, " "))
    out = out.withColumns({"__low": F.lower("__clean"), "__named": named_files(c("__unlinked")), "__from": domain_of(c("from_addr")), "__reply": domain_of(c("reply_to")), "__return": domain_of(c("return_path"))})
    out = out.withColumns({
        "text_length": F.length("__clean"),
        "is_html": c("body").rlike(HTML_MARK),
        "free_mail": c("__from").isin(*FREE_MAIL),
        "reply_to_differs": (c("__reply") != "") & (c("__from") != "") & (c("__reply") != c("__from")),
        "return_path_differs": (c("__return") != "") & (c("__from") != "") & (c("__return") != c("__from")),
        "impersonation": impersonated(c("from_name"), c("subject"), c("__from")),
        "urgent": found(c("__low"), URGENT_WORDS),
        "secrets": found(c("__low"), SECRET_WORDS),
        "prizes": found(c("__low"), PRIZE_WORDS),
        "links": links(c("body")),
        "deceptive": deceptive(c("body")),
        "files": F.concat("attachments", F.array_except("__named", "attachments")),
    })
    out = out.withColumns({
        "dangerous_files": F.filter("files", lambda x: extension(x).isin(*DANGEROUS_EXTENSIONS)),
        "caution_files": F.filter("files", lambda x: extension(x).isin(*CAUTION_EXTENSIONS)),
        "double_files": F.filter("files", lambda x: F.lower(x).rlike(DOUBLE_EXTENSION)),
    })
    return out.drop("__whole", "__clean", "__unlinked", "__low", "__named", "__from", "__reply", "__return")
