"""File features: hashes, type by leading bytes, names and PDF marks as Column expressions; byte entropy and ZIP listings as Arrow batches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.rules import Rule

# Leading bytes and their types in the order of the test; extension sets.
MAGIC = [(b"MZ", "executable-windows"), (b"\x7fELF", "executable-linux"), (b"\xca\xfe\xba\xbe", "executable-mac"), (b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"Rar!\x1a\x07", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"\x1f\x8b", "gzip"), (b"\xd0\xcf\x11\xe0", "ole"), (b"\x89PNG", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"ID3", "media"), (b"\x00\x00\x00\x18ftyp", "media")]
RUNNABLE = ["exe", "dll", "scr", "com", "pif", "cpl", "msi", "msc", "jar", "bat", "cmd", "vbs", "vbe", "js", "jse", "wsf", "wsh", "ps1", "psm1", "hta", "reg", "lnk", "sh", "app", "deb", "rpm"]
SAFE_LOOKING = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "zip", "rar", "csv", "rtf"]
EXPECTED = {
    "pdf": ["pdf"],
    "zip": ["zip", "docx", "xlsx", "pptx", "docm", "xlsm", "pptm", "jar", "apk", "odt", "ods", "epub"],
    "ole": ["doc", "xls", "ppt", "msi", "msg"],
    "executable-windows": ["exe", "dll", "scr", "com", "cpl", "ocx", "sys", "msi", "drv"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp", "ico"],
    "rar": ["rar"],
    "7z": ["7z"],
    "gzip": ["gz", "tgz"],
}
PDF_MARKS = {"javascript": r"(?i)/JavaScript|/JS\b", "auto_open": r"(?i)/OpenAction|/AA\b", "launch": r"(?i)/Launch", "embed": r"(?i)/EmbeddedFile", "submit": r"(?i)/SubmitForm"}
MACRO_TRACES = ("vbaproject.bin", "vbadata.xml", "macros/")
ARCHIVES = ("zip", "rar", "7z", "gz")
LONGEST_EXAMPLE = 80
HIGH_ENTROPY, ENTROPY_BYTES = 7.2, 512 * 1024


def with_file_features(files: DataFrame) -> DataFrame:
    """files: name, content (binary). matches is null where nothing is expected of the type or there is no extension."""
    c = F.col("content")
    plain = F.decode(F.substring(c, 1, 1024), "ISO-8859-1").rlike(r"\A[\x01-\x7F]*\z")
    kind = F.when(F.length(c) == 0, "empty")
    for mark, name in MAGIC:
        kind = kind.when(F.startswith(c, F.lit(mark)), name)
    out = files.withColumn("size", F.length(c)).withColumn("sha256", F.sha2(c, 256)).withColumn("md5", F.md5(c)).withColumn("kind", kind.when(plain, "text").otherwise("unknown"))
    parts = F.split(F.lower("name"), r"\.")
    out = out.withColumn("extension", F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(""))
    before = F.when(F.size(parts) > 2, F.element_at(parts, -2)).otherwise("")
    out = out.withColumn("runnable", F.col("extension").isin(*RUNNABLE)).withColumn("double_extension", before.isin(*SAFE_LOOKING) & F.col("runnable"))
    matches = F.lit(None).cast("boolean")
    for name, allowed in EXPECTED.items():
        matches = F.when((F.col("kind") == name) & (F.col("extension") != ""), F.col("extension").isin(*allowed)).otherwise(matches)
    out = out.withColumn("matches", matches)
    # only PDF bodies are read as text
    body = F.when(F.col("kind") == "pdf", F.decode(c, "ISO-8859-1"))
    return out.select("*", *(F.coalesce(body.rlike(p), F.lit(False)).alias(f"pdf_{n}") for n, p in PDF_MARKS.items()))


def byte_entropy(data: bytes) -> float:
    n = np.bincount(np.frombuffer(data, np.uint8)) if data else np.zeros(0)
    p = n[n > 0] / max(len(data), 1)
    return round(float(-(p * np.log2(p)).sum()) + 0.0, 4)


def zip_listing(data: bytes) -> dict:
    """What an archive holds. One that is no archive is marked as damaged; one that cannot be listed for another reason tells nothing. A name without a dot is its own extension."""
    try:
        names = [x.filename.lower() for x in zipfile.ZipFile(io.BytesIO(data)).infolist()]
    except zipfile.BadZipFile:
        return {"entries": 0, "macro": False, "inner_runnable": 0, "example": None, "nested": 0, "damaged": True}
    except Exception:  # noqa: BLE001  whatever the listing of a hostile archive raises, its row only stays without a listing
        return {"entries": 0, "macro": False, "inner_runnable": 0, "example": None, "nested": 0, "damaged": False}
    last = [x.rsplit(".", 1)[-1] for x in names]
    runs = [x for x, e in zip(names, last, strict=True) if e in RUNNABLE]
    return {"entries": len(names), "macro": any(t in x for x in names for t in MACRO_TRACES), "inner_runnable": len(runs), "example": runs[0][:LONGEST_EXAMPLE] if runs else None, "nested": sum(e in ARCHIVES for e in last), "damaged": False}


def with_content_scan(files: DataFrame) -> DataFrame:
    """id, entropy over the first 512 KiB, and the listing of ZIP files."""
    fields = [("entries", "long", pa.int64()), ("macro", "boolean", pa.bool_()), ("inner_runnable", "long", pa.int64()), ("example", "string", pa.string()), ("nested", "long", pa.int64()), ("damaged", "boolean", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, kinds = batch.column("content"), batch.column("kind").to_pylist()
            entropy, listed = [], []
            for k, kind in enumerate(kinds):
                data = content[k].as_py() or b""
                entropy.append(byte_entropy(data[:ENTROPY_BYTES]))
                listed.append(zip_listing(data) if kind == "zip" else {})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(entropy), *(pa.array([x.get(n) for x in listed], t) for n, _, t in fields)], names=["id", "entropy", *(n for n, _, _ in fields)])

    return files.select("id", "kind", "content").mapInArrow(run, "id long, entropy double, " + ", ".join(f"{n} {t}" for n, t, _ in fields))


def file_rules() -> list[Rule]:
    """Rules over both feature sets. A mismatch counts only where it was checked and is false."""
    c = F.col
    wrong = c("matches").isNotNull() & ~c("matches")
    return [
        Rule("content_mismatch", wrong, F.when(c("kind").startswith("executable"), 0.95).otherwise(0.55), "The content is not what the name says."),
        Rule("double_extension", c("double_extension"), 0.90, "A harmless extension hides a runnable one."),
        Rule("runnable", c("runnable") & ~c("double_extension"), 0.55, "The file runs when it is opened."),
        Rule("macro", F.coalesce("macro", F.lit(False)), 0.80, "The document carries a macro."),
        Rule("inner_runnable", F.coalesce("inner_runnable", F.lit(0)) > 0, 0.75, "A program lies in the archive."),
        Rule("nested_archive", F.coalesce("nested", F.lit(0)) > 0, 0.50, "An archive lies in the archive."),
        Rule("pdf_script", c("pdf_javascript"), F.when(c("pdf_auto_open"), 0.85).otherwise(0.55), "The document runs scripts."),
        Rule("pdf_launch", c("pdf_launch"), 0.80, "The document starts other files."),
        Rule("pdf_embed", c("pdf_embed"), 0.50, "A file is hidden in the document."),
        Rule("high_entropy", (c("entropy") >= HIGH_ENTROPY) & c("kind").isin("executable-windows", "executable-linux", "ole", "unknown"), 0.45, "The content looks packed or encrypted."),
        Rule("damaged_archive", F.coalesce("damaged", F.lit(False)), 0.40, "The archive cannot be read."),
    ]


# Content types that are taken in.
ADMITTED = ["application/pdf", "image/jpeg", "image/png", "text/plain", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]


def admission(content_type: Column, size: Column, limit: int = 10 * 1024 * 1024) -> Column:
    """200, or the status that turns an upload away: 415 for a type that is not listed letter by letter or not given, 413 for too many bytes, 400 for none."""
    return F.when(~F.coalesce(content_type.isin(*ADMITTED), F.lit(False)), 415).when(size > limit, 413).when(F.coalesce(size, F.lit(0)) == 0, 400).otherwise(200)
