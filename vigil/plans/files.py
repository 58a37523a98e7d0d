"""File queries: bytes made of documents behind the leading bytes of each type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import files as X
from vigil.operators import rules as R

PREFIXES = [m.hex().upper() for m, _ in X.MAGIC] + ["", "00", "255044462D2F4A53202F4F70656E416374696F6E", "255044462D2F4C61756E6368202F456D62656464656446696C65", "C3A9"]
NAMES = ["a.pdf", "b.exe", "c.pdf.exe", "d", "e.zip", "f.docx", "g.png", "h.tar.gz", "i.jar", "j.txt", "k.doc.js"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    body = F.when(F.col("doc_id") % 29 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    head = F.when(F.col("doc_id") % 29 == 0, F.lit("")).otherwise(pick(PREFIXES))
    return d.select(F.col("doc_id").alias("id"), pick(NAMES).alias("name"), F.concat(F.unhex(head), body.cast("binary")).alias("content"))


def file_hash_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_file_features(_files(spark, sf_dir)).select("id", "name", "size", "sha256", "md5", "kind", "extension", "runnable", "double_extension", "matches")


def file_pdf_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_file_features(_files(spark, sf_dir)).where("kind = 'pdf'").select("id", *(f"pdf_{n}" for n in X.PDF_MARKS))


def file_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_content_scan(X.with_file_features(_files(spark, sf_dir))).select("id", "entropy", (F.col("entropy") >= X.HIGH_ENTROPY).alias("high"))


def file_rules_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = X.with_file_features(_files(spark, sf_dir))
    both = features.drop("content").join(X.with_content_scan(features), "id").withColumn("rules", R.fired(X.file_rules()))
    score = F.round(R.strongest("rules"), 4)
    return both.select("id", F.array_join(F.transform("rules", lambda x: x["name"]), ",").alias("rules_fired"), score.alias("risk_score"), R.label(score).alias("threat_label"))


TYPES = [*X.ADMITTED, "application/x-msdownload", "TEXT/PLAIN", "text/plain; charset=utf-8", ""]
LARGEST = 20_000


def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 17 != 0, F.element_at(F.array(*map(F.lit, TYPES)), (F.col("id") % len(TYPES) + 1).cast("int")))
    return _files(spark, sf_dir).select("id", kind.alias("content_type"), X.admission(kind, F.length("content"), LARGEST).alias("status"))


_pick = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + f"][doc_id % {len(xs)} + 1]"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_FILES = f"""raw AS (SELECT doc_id AS id, {_pick(NAMES)} AS name, CASE WHEN doc_id % 29 = 0 THEN '' ELSE {_pick(PREFIXES)} || hex(encode(coalesce(text, ''))) END AS h FROM documents),
f AS (SELECT id, name, h, unhex(h) AS content, string_split(lower(name), '.') AS p FROM raw),
g AS (SELECT *, CASE WHEN h = '' THEN 'empty' {" ".join(f"WHEN starts_with(h, '{m.hex().upper()}') THEN '{n}'" for m, n in X.MAGIC)} WHEN regexp_matches(left(h, 2048), '^(0[1-9A-F]|[1-7][0-9A-F])*$') THEN 'text' ELSE 'unknown' END AS kind,
  CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS extension, CASE WHEN len(p) > 2 THEN p[-2] ELSE '' END AS bef FROM f)"""
_MATCH = "CASE " + " ".join(f"WHEN kind = '{k}' AND extension <> '' THEN extension IN {_in(v)}" for k, v in X.EXPECTED.items()) + " END"
ORACLE = {
    "file_hash_sniff": f"WITH {_FILES} SELECT id, name, CAST(length(h) / 2 AS INTEGER) AS size, sha256(content) AS sha256, md5(content) AS md5, kind, extension, extension IN {_in(X.RUNNABLE)} AS runnable, bef IN {_in(X.SAFE_LOOKING)} AND extension IN {_in(X.RUNNABLE)} AS double_extension, {_MATCH} AS matches FROM g",
    "file_admission": f"""WITH {_FILES}, t AS (SELECT id, length(h) / 2 AS size, CASE WHEN id % 17 <> 0 THEN {_pick(TYPES).replace("doc_id", "id")} END AS content_type FROM g)
      SELECT id, content_type, CASE WHEN content_type IS NULL OR content_type NOT IN {_in(X.ADMITTED)} THEN 415 WHEN size > {LARGEST} THEN 413 WHEN size = 0 THEN 400 ELSE 200 END AS status FROM t""",
    "file_entropy": f"WITH {_FILES}, e AS (SELECT id, round(coalesce(list_entropy(regexp_extract_all(left(h, {2 * X.ENTROPY_BYTES}), '..')), 0), 4) AS entropy FROM g) SELECT id, entropy, entropy >= {X.HIGH_ENTROPY} AS high FROM e",
}
QUERIES = {f.__name__: f for f in (file_hash_sniff, file_admission, file_pdf_marks, file_entropy, file_rules_scored)}
