"""Page and evidence queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import dictionaries as D
from vigil.functions import pages as P
from vigil.operators import rules as R
from vigil.plans import urls

# Pieces put after the pages, and what each adds by hand: password fields, forms, hidden frames, scrambled.
SNIPPETS = {
    "": (0, 0, 0, False),
    "<form action='https://a.org/x'><input name=p type=\"password\"></form>": (1, 1, 0, False),
    "<iframe src=x width=\"0\"></iframe><IFRAME style='display: none'></IFRAME>": (0, 0, 2, False),
    "<script>eval(atob('x'))</script> LOGIN password otp cvv token": (0, 0, 0, True),
    "<p>slot gacor maxwin toto bonus</p><!-- password -->": (0, 0, 0, False),
    "<p>eval(atob('x')) A &amp; B&nbsp;login</p><!-- <script>eval(atob('x'))</script> -->": (0, 0, 0, False),
}

# Pages read by hand: title, password fields, forms, hidden frames, scrambled, credential words, gambling words, strong ones.
PROBES = {
    "<!-- <form><input type=\"password\"><iframe hidden></iframe></form> -->": ("", 0, 0, 0, False, 0, 0, 0),
    "<script>var a = '<form><input type=password></form>';</script>": ("", 0, 0, 0, False, 0, 0, 0),
    "<input type=\"password-hint\"><input data-type=password><input TYPE = 'PassWord'>": ("", 1, 0, 0, False, 0, 0, 0),
    "<input type=text type=password><input type=password type=text><input type=\"pass&#119;ord\"/>": ("", 2, 0, 0, False, 0, 0, 0),
    "<iframe title=\"not hidden here\"></iframe><iframe hidden></iframe><iframe hidden=until-found></iframe>": ("", 0, 0, 2, False, 0, 0, 0),
    "<iframe style=\"color:red; DISPLAY : none\"></iframe><iframe width=' 0px '></iframe><iframe width=00></iframe>": ("", 0, 0, 2, False, 0, 0, 0),
    "<b>sign</b> in <b>no</b> rekening kata\nsandi": ("", 0, 0, 0, False, 3, 0, 0),
    "<title> Caf&eacute; &#233;&#xe9;&#150; &amp;amp; </title><title>second</title>": ("Café éé– &amp;", 0, 0, 0, False, 0, 0, 0),
    "<title>a<b>c</b></title>": ("", 0, 0, 0, False, 0, 0, 0),
    "<a title=\"x > <form>\" href=q>ju<i></i>di</a><form\n>judi": ("", 0, 1, 0, False, 0, 1, 1),
    "1 < 2 &lt;form&gt; otp &notathing; <style>p { content: 'judi' }</style><STYLE/>slot": ("", 0, 0, 0, False, 1, 1, 1),
    "<template><form><input type=password></form>slot</template>togel": ("", 1, 1, 0, False, 0, 1, 1),
    "<script src=x /><form></form><script>eval ( unescape('%61'))": ("", 0, 1, 0, True, 0, 0, 0),
    "<!doctype html><?php judi ?></ judi><form": ("", 0, 0, 0, False, 0, 0, 0),
    "<p>log<!-- -->in</p><p>lo&#103;in</p>": ("", 0, 0, 0, False, 1, 0, 0),
    "": ("", 0, 0, 0, False, 0, 0, 0),
}

# url, page, foreign target, brand; by hand
SITES = [
    ("https://shop.example.com/a", "<form action=' https://collect.other.org/x '>", "other.org", None),
    ("https://shop.example.com/a", "<form action=HTTPS://collect.other.org><form action=/x><form action='https://www.example.com/y'>", None, None),
    ("https://shop.example.com/a", "<!-- <form action='https://other.org'> --><form action='https://1.2.3.4/'><form action='http&#58;//third.net'>", "third.net", None),
    ("https://shop.example.com/a", "<p>Your PayPal</p><script>paypal</script>", None, "paypal"),
    ("https://www.paypal.com/a", "<p>Your PayPal account at paypals</p>", None, None),
    ("http://1.2.3.4/a", "<form action='https://other.org'>grabbing gr<b>a</b>b", None, None),
]
_q = lambda x: "'" + x.replace("'", "''") + "'"
EVIDENCE = ["title", "password_fields", "forms", "hidden_frames", "scrambled", "credential_words", "gambling_words", "strong_gambling_words"]


def _piece(more: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, more)), (F.col("page_id") % len(more) + 1).cast("int"))


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", _piece([*SNIPPETS])).alias("html"))
    probes = spark.createDataFrame([(-1 - k, h) for k, h in enumerate(PROBES)], "page_id long, html string")
    return P.with_page_features(pages.unionByName(probes), longest=None).select("page_id", *EVIDENCE)


_SHOWN = "<p>Your PayPal account</p>"


def page_site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat("html", _piece([*SNIPPETS, _SHOWN])).alias("html"))
    sites = spark.createDataFrame([(-1 - k, u, h) for k, (u, h, _, _) in enumerate(SITES)], "page_id long, url string, html string")
    return P.with_site_features(pages.unionByName(sites), urls.suffixes(spark)).select("page_id", "foreign_target", "foreign_form", "brand")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence made of event ids, so that every rule fires somewhere and every value is unknown somewhere."""
    e = F.col("event_id")
    some = lambda m, r: F.when(e % 11 != r, e % m == 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("id"), F.when(e % 13 != 0, e * 37 % 3000).alias("age_days"), some(3, 1).alias("password"), F.when(e % 4 == 0, "paypal").alias("brand"), some(5, 2).alias("foreign_form"), some(7, 3).alias("moved"),
        F.when(e % 6 != 0, e % 5 != 0).alias("has_certificate"), F.when(e % 6 != 1, e % 8 != 0).alias("certificate_fits"), some(9, 4).alias("scrambled"), (e % 5).alias("hidden_frames"), (e % 6).alias("credential_words"), (e % 10).alias("gambling_words"), F.when(e % 7 == 0, e % 4).otherwise(0).alias("strong_gambling_words"), (e * 31 % 101 / 100).alias("deep"), some(2, 5).alias("readable"),
    )


def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _evidence(spark, sf_dir).withColumn("rules", R.fired(P.evidence_rules()))
    score = F.round(F.greatest(R.strongest("rules"), F.coalesce(P.deep_weight(F.col("deep"), F.col("readable")), F.lit(0.0))), 4)
    return out.select("id", F.array_join(F.transform("rules", lambda x: x["name"]), ",").alias("rules_fired"), score.alias("risk_score"), R.label(score).alias("threat_label"))


def _words(xs) -> str:
    return " + ".join(f"CAST(contains(t, {_q(w)}) AS INTEGER)" for w in xs)


_DAMP = "(CASE WHEN age_days >= 2190 THEN 0.25 WHEN age_days >= 730 THEN 0.5 ELSE 1.0 END)"
_PW = "coalesce(password, FALSE)"
_RULES = [
    ("page_gambling", "strong >= 1 OR words >= 4", "CASE WHEN strong >= 3 OR words >= 8 THEN 0.95 ELSE 0.80 END"),
    ("password_and_brand", f"{_PW} AND brand IS NOT NULL AND round(0.95 * {_DAMP}, 3) >= 0.15", f"round(CAST(0.95 * {_DAMP} AS DOUBLE), 3)"),
    ("password_on_young_domain", f"{_PW} AND brand IS NULL AND age_days <= 30", "0.90"),
    ("foreign_form", "foreign_form", f"CASE WHEN {_PW} THEN 0.90 ELSE 0.70 END"),
    ("young_domain", f"NOT {_PW} AND age_days <= 30", "CASE WHEN age_days <= 7 THEN 0.50 ELSE 0.40 END"),
    ("moved", "moved", "0.55"),
    ("certificate", "has_certificate AND NOT certificate_fits", "0.60"),
    ("no_certificate", f"NOT has_certificate AND {_PW}", "0.75"),
    ("scrambled_script", f"scrambled AND round(CAST((CASE WHEN {_PW} THEN 0.70 ELSE 0.35 END) * {_DAMP} AS DOUBLE), 3) >= 0.15", f"round(CAST((CASE WHEN {_PW} THEN 0.70 ELSE 0.35 END) * {_DAMP} AS DOUBLE), 3)"),
    ("hidden_frame", f"frames > 0 AND round(CAST((CASE WHEN {_PW} THEN 0.70 WHEN frames >= 3 THEN 0.50 ELSE 0.20 END) * {_DAMP} AS DOUBLE), 3) >= 0.15", f"round(CAST((CASE WHEN {_PW} THEN 0.70 WHEN frames >= 3 THEN 0.50 ELSE 0.20 END) * {_DAMP} AS DOUBLE), 3)"),
    ("asks_for_secrets", f"asks >= 4 AND NOT {_PW}", "0.45"),
]
_some = lambda m, r, n: f"CASE WHEN event_id % 11 <> {r} THEN event_id % {m} = 0 END AS {n}"
_ESCAPED = {"&amp": "&", "&lt": "<", "&gt": ">", "&quot": '"', "&apos": "'", "&#39": "'", "&#x27": "'"}
_ENTITY = "&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][-.a-zA-Z0-9]*;?|[^&]+|&"
_DECODED = f"CASE WHEN NOT starts_with(x, '&') OR x = '&' THEN x {' '.join(f'WHEN x IN ({_q(k)}, {_q(k)} || chr(59)) THEN {_q(v)}' for k, v in _ESCAPED.items())} ELSE regexp_replace(x, ';$', '') END"
ORACLE = {
    # the pages themselves hold neither forms, fields nor frames, and no entities but those of _ESCAPED, with or without their semicolon, in titles; what their pieces add is known
    "page_evidence": rf"""WITH h AS (SELECT page_id, html || [{", ".join(map(_q, SNIPPETS))}][page_id % {len(SNIPPETS)} + 1] AS h, page_id % {len(SNIPPETS)} + 1 AS k FROM pages),
      c AS (SELECT *, regexp_replace(regexp_replace(h, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>', chr(1), 'g'), '&nbsp;', ' ', 'g') AS cut FROM h),
      v AS (SELECT *, array_to_string(list_filter(list_transform(string_split(lower(replace(cut, '&amp;', '&')), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> ''), ' ') AS t FROM c)
      SELECT page_id, trim(array_to_string(list_transform(regexp_extract_all(regexp_extract(h, '(?is)<title[^>]*>([^<]*)</title>', 1), {_q(_ENTITY)}), lambda x: {_DECODED}), '')) AS title, {", ".join(f"[{', '.join(str(v[j]).upper() for v in SNIPPETS.values())}][k] AS {name}" for j, name in enumerate(EVIDENCE[1:5]))},
        {_words(P.CREDENTIAL_WORDS)} AS credential_words, {_words(D.GAMBLING_WORDS)} AS gambling_words, {_words(D.STRONG_GAMBLING_WORDS)} AS strong_gambling_words FROM v
      UNION ALL SELECT CAST(id AS BIGINT), * EXCLUDE (id) FROM (VALUES {", ".join(f"({-1 - k}, {_q(v[0])}, {', '.join(str(x).upper() for x in v[1:])})" for k, v in enumerate(PROBES.values()))}) AS known(id, {", ".join(EVIDENCE)})""",
    "page_site_evidence": rf"""WITH {urls.HOSTS_SQL.replace(urls.SOURCE_SQL, "SELECT page_id AS id, url FROM pages")},
      h AS (SELECT id, registered, page_id % {len(SNIPPETS) + 1} AS k, lower(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>', ' ', 'g')) || CASE WHEN page_id % {len(SNIPPETS) + 1} = {len(SNIPPETS)} THEN ' paypal' ELSE '' END AS t FROM hosts JOIN pages ON id = page_id WHERE suffix <> '')
      SELECT id AS page_id, CASE WHEN k = 1 AND registered <> 'a.org' THEN 'a.org' END AS foreign_target, k = 1 AND registered <> 'a.org' AS foreign_form,
        CASE {" ".join(f"WHEN registered <> {_q(o)} AND regexp_matches(t, '(^|[^a-z0-9]){b}($|[^a-z0-9])') THEN {_q(b)}" for b, o in D.BRANDS.items())} END AS brand FROM h
      UNION ALL SELECT CAST(id AS BIGINT), target, target IS NOT NULL, brand FROM (VALUES {", ".join(f"({-1 - k}, {_q(t) if t else 'NULL'}, {_q(b) if b else 'NULL'})" for k, (_, _, t, b) in enumerate(SITES))}) AS known(id, target, brand)""",
    "evidence_rules": f"""WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 13 <> 0 THEN event_id * 37 % 3000 END AS age_days, {_some(3, 1, "password")}, CASE WHEN event_id % 4 = 0 THEN 'paypal' END AS brand, {_some(5, 2, "foreign_form")}, {_some(7, 3, "moved")},
      CASE WHEN event_id % 6 <> 0 THEN event_id % 5 <> 0 END AS has_certificate, CASE WHEN event_id % 6 <> 1 THEN event_id % 8 <> 0 END AS certificate_fits, {_some(9, 4, "scrambled")}, event_id % 5 AS frames, event_id % 6 AS asks, event_id % 10 AS words,
      CASE WHEN event_id % 7 = 0 THEN event_id % 4 ELSE 0 END AS strong, CAST(event_id * 31 % 101 AS DOUBLE) / 100 AS deep, {_some(2, 5, "readable")} FROM events),
      r AS (SELECT id, list_filter([{", ".join(f"CASE WHEN {c} THEN {{'w': CAST({w} AS DOUBLE), 'n': '{n}'}} END" for n, c, w in _RULES)}], lambda x: x IS NOT NULL) AS r,
        CASE WHEN readable THEN CASE WHEN deep >= 0.90 THEN 0.85 WHEN deep >= 0.75 THEN 0.60 WHEN deep >= 0.60 THEN 0.45 ELSE 0.0 END ELSE 0.0 END AS d FROM e),
      s AS (SELECT *, round(CAST(greatest(coalesce(list_max(list_transform(r, lambda x: x.w)), 0.0), d) AS DOUBLE), 4) AS risk_score FROM r)
      SELECT id, coalesce(array_to_string(list_transform(r, lambda x: x.n), ','), '') AS rules_fired, risk_score, CASE WHEN risk_score >= 0.70 THEN 'Malicious' WHEN risk_score >= 0.40 THEN 'Suspicious' ELSE 'Safe' END AS threat_label FROM s""",
}
QUERIES = {f.__name__: f for f in (page_evidence, page_site_evidence, evidence_rules)}
