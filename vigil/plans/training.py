"""Evidence vector and training queries. The tree counts are small; `operators.training` holds the full defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import vector as V
from vigil.operators import shap as S
from vigil.operators import training as T

TREES, DEPTH = 10, 3
COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence made of event ids; each column is unknown somewhere."""
    e = F.col("event_id")
    some = lambda m, r: F.when(e % 11 != r, e % m == 0)
    country = F.when(e % 9 != 0, F.element_at(F.array(*map(F.lit, [*V.COUNTRIES, "us", "BR", ""])), (e % 13 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("id"), F.when(e % 13 != 0, e * 37 % 3000).alias("age_days"), country.alias("country"), F.when(e % 5 != 0, "1.2.3.4").alias("ip"), F.when(e % 6 != 0, e % 5 != 0).alias("has_certificate"), some(8, 1).alias("certificate_fits"), F.when(e % 7 != 0, e % 90).alias("certificate_days"),
        F.when(e % 8 != 0, F.lit(200) + (e % 4) * 101).alias("status"), (e % 4).alias("hops"), some(7, 3).alias("moved"), some(2, 5).alias("readable"), some(3, 1).alias("password"), (e % 3).alias("password_fields"), some(5, 2).alias("foreign_form"),
        (e % 6).alias("credential_words"), F.when(e % 4 == 0, "paypal").alias("brand"), (e % 5).alias("hidden_frames"), some(9, 4).alias("scrambled"), F.when(e % 10 != 0, e * 977 % 100_000).alias("page_bytes"), F.when(e % 3 == 0, "A title").when(e % 3 == 1, "").alias("title"),
    )


def evidence_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_vector(_sites(spark, sf_dir)).select("id", *V.names())


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir).withColumns({"forms": F.col("id") % 3, "final_url": F.when(F.col("id") % 4 == 1, F.repeat(F.lit("http://a.b/"), (F.col("id") % 12).cast("int"))), "certificate_issuer": F.when(F.col("id") % 5 == 1, "Some Issuer").when(F.col("id") % 5 == 2, "")})
    return V.with_summary(sites).select("id", F.array_join(F.transform("summary", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ").alias("summary"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class that two columns tell in most rows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *COLUMNS)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    noise = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(10)) == 0
    return rows.withColumns({"key": key, "y": F.when(((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.04)) != noise, 1).otherwise(0)})


def _trained(spark: SparkSession, sf_dir: str) -> T.Trained:
    return T.best_candidate(_rows(spark, sf_dir), COLUMNS, "key", "y", T.learners(TREES, DEPTH))


def train_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).metrics


def train_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.importances(_trained(spark, sf_dir))


def train_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.out_of_fold(_rows(spark, sf_dir), COLUMNS, "key", "y", T.evidence_learner(TREES, DEPTH))


def train_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean size of each column's Shapley values over all rows, of boosted trees."""
    rows = _rows(spark, sf_dir)
    model = T.evidence_learner(TREES, DEPTH).fit(T.dealt(T.assembled(rows, COLUMNS), rows.count(), "key", "features", "y").select("features", "y"))
    return S.mean_sizes(rows, model, COLUMNS)


def train_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each class each fold holds, over line items with the return flag as class."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("key"))
    return T.stratified(rows, "l_returnflag", "key").groupBy("l_returnflag", F.col("__fold").alias("fold")).agg(F.count("*").alias("n"))


def leakage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.leakage_verdict(_rows(spark, sf_dir), COLUMNS, "key", "key")


_e = "event_id"
_some = lambda m, r: f"coalesce({_e} % 11 <> {r} AND {_e} % {m} = 0, FALSE)"
_int = lambda x: f"CAST({x} AS INTEGER)"
_countries = ", ".join(f"'{x}'" for x in V.COUNTRIES)
ORACLE = {
    "evidence_summary": f"""WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 13 <> 0 THEN event_id * 37 % 3000 END AS age, event_id % 6 <> 0 AS checked, event_id % 5 <> 0 AS cert, CASE WHEN event_id % 11 <> 1 THEN event_id % 8 = 0 END AS fits, CASE event_id % 5 WHEN 1 THEN 'Some Issuer' ELSE 'a trusted party' END AS issuer,
        CASE WHEN event_id % 8 <> 0 THEN 200 + (event_id % 4) * 101 END AS status, event_id % 4 AS hops, CASE WHEN event_id % 4 = 1 THEN left(repeat('http://a.b/', CAST(event_id % 12 AS BIGINT)), 90) END AS final, CASE WHEN event_id % 11 <> 5 THEN event_id % 2 = 0 END AS readable, coalesce(CASE WHEN event_id % 11 <> 1 THEN event_id % 3 = 0 END, FALSE) AS password FROM events)
      SELECT id, array_to_string(list_filter([CASE WHEN age >= 365 THEN 'age=' || age || ' days (~' || printf('%.1f', round(CAST(age AS DOUBLE) / 365, 1)) || ' years)' ELSE 'age=' || age || ' days' END, CASE WHEN id % 5 <> 0 THEN 'ip=1.2.3.4' END,
        CASE WHEN checked THEN 'certificate=' || CASE WHEN cert AND coalesce(fits, FALSE) THEN 'valid, by ' || issuer WHEN cert THEN 'there, but another''s' ELSE 'none' END END, 'status=' || status, CASE WHEN hops > 0 THEN 'redirects=' || hops END, CASE WHEN final <> '' THEN 'final_url=' || final END,
        CASE WHEN id % 3 = 0 THEN 'title=A title' END, CASE WHEN readable THEN 'password_field=' || CASE WHEN password THEN 'yes' ELSE 'no' END END, CASE WHEN readable THEN 'forms=' || id % 3 END], lambda x: x IS NOT NULL), '; ') AS summary FROM s""",
    "train_folds": "SELECT l_returnflag, CAST(k AS INTEGER) AS fold, count(*) // 5 + CASE WHEN k < count(*) % 5 THEN 1 ELSE 0 END AS n FROM lineitem, range(5) AS f(k) GROUP BY l_returnflag, k",
    "evidence_vector": f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN event_id * 37 % 3000 END AS age, upper(CASE WHEN event_id % 9 <> 0 THEN [{_countries}, 'us', 'BR', ''][event_id % 13 + 1] ELSE '' END) AS country,
        CASE WHEN event_id % 7 <> 0 THEN event_id % 90 END AS cdays, CASE WHEN event_id % 8 <> 0 THEN 200 + (event_id % 4) * 101 END AS status, event_id % 6 <> 0 AS checked, event_id % 6 <> 0 AND event_id % 5 <> 0 AS cert,
        {_some(8, 1)} AS fits, {_some(7, 3)} AS moved, {_some(2, 5)} AS readable, {_some(3, 1)} AS password, {_some(5, 2)} AS ff, {_some(9, 4)} AS scrambled, event_id % 4 = 0 AS brand,
        CASE WHEN event_id % 10 <> 0 THEN event_id * 977 % 100000 ELSE 0 END AS bytes, CASE WHEN event_id % 3 = 0 THEN 'A title' ELSE '' END AS title FROM events)
      SELECT event_id AS id, {_int("age IS NOT NULL")} AS d_has_age, CAST(coalesce(age, -1) AS DOUBLE) AS d_age_days, {_int("coalesce(age <= 7, FALSE)")} AS d_age_to_7, {_int("coalesce(age <= 30, FALSE)")} AS d_age_to_30, {_int("coalesce(age <= 180, FALSE)")} AS d_age_to_180, {_int("coalesce(age >= 1095, FALSE)")} AS d_age_from_1095,
      {_int("country <> ''")} AS d_has_country, {", ".join(f"{_int(f"country = '{k}'")} AS d_country_{k}" for k in V.COUNTRIES)}, {_int(f"country <> '' AND country NOT IN ({_countries})")} AS d_country_other, {_int("event_id % 5 <> 0")} AS d_has_ip,
      {_int("checked")} AS d_certificate_checked, {_int("cert")} AS d_has_certificate, {_int("fits")} AS d_certificate_fits, CAST(coalesce(cdays, -1) AS DOUBLE) AS d_certificate_days, {_int("coalesce(cdays <= 30, FALSE)")} AS d_certificate_new,
      {_int("status IS NOT NULL")} AS d_opened, {_int("coalesce(status = 200, FALSE)")} AS d_status_200, {_int("coalesce(status >= 400 AND status < 500, FALSE)")} AS d_status_4xx, CAST(event_id % 4 AS DOUBLE) AS d_hops, {_int("moved")} AS d_moved,
      {_int("readable")} AS d_readable, {_int("password")} AS d_password, CAST(event_id % 3 AS DOUBLE) AS d_password_fields, CAST(0 AS DOUBLE) AS d_forms, {_int("ff")} AS d_foreign_form, CAST(event_id % 6 AS DOUBLE) AS d_credential_words, CAST(0 AS DOUBLE) AS d_gambling_words, CAST(0 AS DOUBLE) AS d_strong_gambling_words,
      {_int("brand")} AS d_brand, CAST(event_id % 5 AS DOUBLE) AS d_hidden_frames, {_int("scrambled")} AS d_scrambled, round_even(CAST(bytes AS DOUBLE) / 1024, 2) AS d_page_kb, CAST(length(title) AS INTEGER) AS d_title_length, {_int("title <> ''")} AS d_has_title,
      {_int("password AND coalesce(age <= 30, FALSE)")} AS d_password_and_young, {_int("password AND brand")} AS d_password_and_brand, {_int("password AND NOT cert")} AS d_password_no_certificate, {_int("password AND ff")} AS d_password_and_foreign_form FROM s""",
}
QUERIES = {f.__name__: f for f in (evidence_vector, evidence_summary, train_candidates, train_importances, train_out_of_fold, train_folds, train_shap, leakage_verdict)}
