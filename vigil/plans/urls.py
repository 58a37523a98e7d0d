"""URL queries: page addresses together with one seed or more for each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import dictionaries as D
from vigil.functions import url as U
from vigil.operators import rules as R

SEEDS = ["https://gacor-slot-emas77.net/masuk", "http://toto9.net", "togel-hadiah9.site", "paypal.xyz/login", "https://bca-layanan.com", "gooogle.com", "bukalapek.com", "http://192.168.10.5/a", "http://999.1.1.1", "xn--pypal-4ve.com", "secure-login.top", "plain.icu", "my-shop.vercel.app/signin", "my-shop.pages.dev", "www.github.io", "minecraft.com.am", "example.co.uk/verify/now", "bit.ly/x", "example.com:8080", "example.com:99999", "localhost:8000/x", "https:google.com", "https://google.com//login", "  spaced .com ", "user:pw@host.org/p?q#f", "", "://broken", "!!!", "ftp://files.example.de/a", "freefire.garena.com", "ff.garena.com", "dana.id", "aaaabbbb1c2d3.com", "sub.deep.example.co.id", "unknown.zzz", "HTTPS://WWW.FACEBOOK.COM/LOGIN", "metamask-wallet-verify.website", "casino.im", "co.uk", "a-b_c.d1e2.org"]

_quote = lambda x: "'" + x.replace("'", "''") + "'"
_list = lambda xs: "(" + ", ".join(map(_quote, xs)) + ")"
SOURCE_SQL = "SELECT page_id AS id, url FROM pages UNION ALL SELECT CAST(id AS BIGINT), url FROM (VALUES " + ", ".join(f"({-1 - k}, {_quote(s)})" for k, s in enumerate(SEEDS)) + ") AS seeds(id, url)"


# A table of public suffixes with wildcards and exceptions.
RULES = sorted({*D.SUSPICIOUS_TLDS, *D.COMMON_TLDS, "uk", "am", "et", "im", "info", "biz", "us", "ru", "cn", "br", "com.br", "in", "co.in", "com.au", "ly", "gl", "gd", "st", "do", "gy", "me", "sh", "org.uk", "ac.uk", "com.sg", "sg", "my", "com.my", "kr", "co.kr", "co.jp", "eu", "tv", "cc", "pl", "tr", "com.tr", "za", "co.za", "mx", "com.mx", "link", "live", "shop", "store", "tech", "cloud", "ai", "ws", "th", "co.th", "vn", "com.vn", "nu", "ck", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "a.b.c.d.com", "x.one.two.three.four.five.org", " DEV "})


def suffixes(spark: SparkSession) -> U.Suffixes:
    return U.Suffixes(spark.createDataFrame([(r,) for r in RULES], "rule string"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(-1 - k, s) for k, s in enumerate(SEEDS)], "id long, url string")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url").unionByName(seeds)


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_host(inputs(spark, sf_dir), suffixes(spark))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_features(hosts(spark, sf_dir))


HOSTS_SQL = rf"""
source AS ({SOURCE_SQL}),
trimmed AS (SELECT id, url, replace(regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g'), ' ', '') AS t FROM source),
named AS (SELECT id, url, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN t
  WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:[^0-9/]') OR regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:/([^/]|$)') THEN regexp_replace(t, '^([a-zA-Z][a-zA-Z0-9+.-]*):', '\1://')
  ELSE 'http://' || t END AS text FROM trimmed),
auth AS (SELECT *, regexp_replace(regexp_extract(text, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS authority FROM named),
host AS (SELECT *, lower(split_part(authority, ':', 1)) AS host FROM auth),
ip AS (SELECT *, regexp_matches(host, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') AS is_ip, string_split(host, '.') AS p FROM host),
rules AS (SELECT lower(trim(unnest([{", ".join(map(_quote, RULES))}]))) AS rule),
tails AS (SELECT id, n, array_to_string(p[-n:], '.') AS tail, array_to_string(p[-n:][2:], '.') AS rest FROM ip, range(1, 8) AS r(n) WHERE n <= len(p) AND NOT is_ip),
found AS (SELECT id, tail AS suffix, n, 0 AS special FROM tails JOIN rules ON rule = tail UNION ALL SELECT id, tail, n, 0 FROM tails JOIN rules ON n > 1 AND rule = '*.' || rest UNION ALL SELECT id, rest, n, 1 FROM tails JOIN rules ON rule = '!' || tail),
suf AS (SELECT ip.*, coalesce(f.suffix, '') AS suffix FROM ip LEFT JOIN (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY special DESC, n DESC) = 1) f USING (id)),
bef AS (SELECT *, CASE WHEN suffix = '' THEN host ELSE left(host, greatest(length(host) - length(suffix) - 1, 0)) END AS bef FROM suf),
dom AS (SELECT *, CASE WHEN is_ip THEN host ELSE string_split(bef, '.')[-1] END AS domain FROM bef),
sub AS (SELECT *, left(bef, greatest(length(bef) - length(domain) - 1, 0)) AS subdomain FROM dom),
hosts AS (SELECT id, url, text, authority, host, is_ip, suffix, domain, subdomain, CASE WHEN suffix <> '' AND domain <> '' THEN domain || '.' || suffix ELSE '' END AS registered,
  CASE WHEN subdomain <> '' THEN subdomain || '.' || domain ELSE domain END AS checked FROM sub)"""


def _count(words, text="checked") -> str:
    return " + ".join(f"CAST(contains({text}, {_quote(w)}) AS INTEGER)" for w in words)


_BRAND = "CASE " + " ".join(f"WHEN list_contains(tokens, {_quote(b)})" + (f" OR contains(checked, {_quote(b)})" if len(b) >= 6 else "") + f" THEN {_quote(b)}" for b in D.BRANDS) + " END"
_OFFICIAL = "CASE brand " + " ".join(f"WHEN {_quote(b)} THEN {_quote(o)}" for b, o in D.BRANDS.items()) + " END"
FEATURES_SQL = rf"""{HOSTS_SQL},
tok AS (SELECT *, list_filter(string_split_regex(checked, '[-_.0-9]+'), lambda x: x <> '') AS tokens FROM hosts),
f1 AS (SELECT *, {_BRAND} AS brand,
  CAST(CASE WHEN length(domain) < 5 THEN 3 ELSE least(3, {", ".join(f"levenshtein(domain, {_quote(b)})" for b in D.BRANDS if len(b) >= 6)}) END AS INTEGER) AS brand_edit_distance,
  {_count(D.PHISHING_WORDS)} AS phishing_keyword_count, {_count(D.GAMBLING_WORDS)} AS judol_keyword_count, {_count(D.STRONG_GAMBLING_WORDS)} AS judol_strong_count,
  CAST(is_ip AS INTEGER) AS has_ip_address, CASE WHEN TRY_CAST(regexp_extract(authority, ':([0-9]+)$', 1) AS INTEGER) <= 65535 THEN 1 ELSE 0 END AS has_port,
  CAST(contains(host, 'xn--') AS INTEGER) AS has_punycode, CAST(registered IN {_list(D.SHORTENERS)} AS INTEGER) AS is_shortener,
  CAST(suffix IN {_list(D.SUSPICIOUS_TLDS)} AS INTEGER) AS suspicious_tld, CAST(suffix IN {_list(D.COMMON_TLDS)} AS INTEGER) AS common_tld FROM tok),
features AS (SELECT *, CAST(brand IS NOT NULL AS INTEGER) AS contains_brand, coalesce(CAST({_OFFICIAL} <> registered AS INTEGER), 0) AS brand_impersonation,
  CAST(phishing_keyword_count > 0 AS INTEGER) AS has_phishing_keyword, CAST(judol_keyword_count > 0 AS INTEGER) AS has_judol_keyword FROM f1)"""


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).select("id", "text", "host", "subdomain", "domain", "suffix", "registered")


# Hosts that tell its rules apart; the answers of some by hand.
SUFFIX_SEEDS = ["http://a.co.th", "http://x.com.vn", "x.nu", "shop.any.ck", "any.ck", "ck", "www.ck", "deep.www.ck", "x.y.kawasaki.jp", "www.city.kawasaki.jp", "kawasaki.jp", "z.a.b.c.d.com", "b.c.d.com", "my.pages.dev", "pages.dev", "co.uk", "x.unknownzone", "com.am", "w.x.one.two.three.four.five.org", "one.two.three.four.five.org", "http://a.b.co.th/login", "shop.com.vn"]


def url_public_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-2000 - k, s) for k, s in enumerate(SUFFIX_SEEDS)], "id long, url string")
    return U.with_host(inputs(spark, sf_dir).unionByName(more), suffixes(spark)).select("id", "host", "subdomain", "domain", "suffix", "registered")


def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs(spark, sf_dir).select("id", U.normalised(F.col("url")).alias("text"), U.reject_reason(F.col("url")).alias("reject_reason"))


def url_lexical_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "hostname_length", "domain_length", "tld_length", "subdomain_count", "domain_entropy", "hostname_entropy", "count_digit", "digit_ratio", "count_hyphen", "hyphen_ratio", "vowel_ratio")


def url_runs_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "longest_consonant_run", "max_char_repeat", "digit_letter_transitions", "token_count", "avg_token_length", "max_token_length")


def url_host_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "has_ip_address", "has_port", "has_punycode", "is_shortener", "suspicious_tld", "common_tld")


def url_brand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "brand", "contains_brand", "brand_impersonation", "brand_edit_distance")


def url_keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("id", "phishing_keyword_count", "has_phishing_keyword", "judol_keyword_count", "has_judol_keyword", "judol_strong_count")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = hosts(spark, sf_dir).where("id >= 0 and registered > '' and registered < 'm'").select("registered").unionByName(spark.createDataFrame([("google.com",), ("plain.icu",), ("ff.garena.com",)], "registered string"))
    return R.fused(features(spark, sf_dir), F.pmod(F.col("id") * 37, F.lit(100)) / 100, allowed)


def url_rules_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", F.array_join(F.transform("rules", lambda x: x["name"]), ",").alias("rules_fired"), "allowlisted", "risk_score", "threat_label")


def url_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _fused(spark, sf_dir).withColumn("why", F.concat(R.explained("rules"), R.url_notes(F.pmod(F.col("id") * 37, F.lit(100)) / 100)))
    return listed.select("id", F.array_join(F.transform("why", lambda x: x["title"]), ">").alias("titles"), F.size("why").alias("n_reasons"), F.coalesce(F.element_at(F.transform("why", lambda x: x["reason"]), F.when(F.size("why") > 0, 1)), F.lit("")).alias("first_reason"))


_HOSTED = f"(registered IN {_list(D.FREE_HOSTING)} AND subdomain NOT IN ('', 'www'))"
_PATH = "(" + " OR ".join(f"contains(path, {_quote(w)})" for w in D.PATH_WORDS) + ")"
_RULES = [
    ("gambling", "judol_strong_count >= 1 OR judol_keyword_count >= 2", "CASE WHEN judol_strong_count >= 2 THEN 0.95 WHEN judol_strong_count = 1 THEN 0.85 ELSE 0.70 END"),
    ("brand_impersonation", "brand_impersonation = 1", "0.90"),
    ("typosquatting", "brand_edit_distance BETWEEN 1 AND 2 AND brand_impersonation = 0", "0.85"),
    ("raw_ip", "has_ip_address = 1", "0.85"),
    ("punycode", "has_punycode = 1", "0.85"),
    ("cheap_tld", "suspicious_tld = 1", "CASE WHEN has_phishing_keyword = 1 THEN 0.75 ELSE 0.30 END"),
    ("free_hosting", _HOSTED, f"CASE WHEN {_PATH} OR has_phishing_keyword = 1 THEN 0.80 ELSE 0.55 END"),
    ("fake_suffix", f"string_split(checked, '.')[-1] IN {_list(D.FAKE_INNER_SUFFIXES)} AND suffix <> '' AND suffix <> string_split(checked, '.')[-1]", "0.85"),
    ("path_word", f"{_PATH} AND NOT {_HOSTED}", "0.50"),
    ("shortener", "is_shortener = 1", "0.50"),
    ("port", "has_port = 1", "0.40"),
]
FUSED_SQL = rf"""{FEATURES_SQL},
paths AS (SELECT *, string_split(lower(text), '//')[-1] AS tail FROM features),
pathed AS (SELECT *, CASE WHEN contains(tail, '/') THEN substr(tail, instr(tail, '/')) ELSE '' END AS path FROM paths),
allowed AS (SELECT DISTINCT registered FROM hosts WHERE id >= 0 AND registered > '' AND registered < 'm' UNION SELECT unnest(['google.com', 'plain.icu', 'ff.garena.com'])),
ruled AS (SELECT *, registered IN (SELECT registered FROM allowed) AS allowlisted,
  list_filter([{", ".join(f"CASE WHEN {c} THEN {{'o': {k}, 'w': CAST({w} AS DOUBLE), 'n': '{n}'}} END" for k, (n, c, w) in enumerate(_RULES))}], lambda x: x IS NOT NULL) AS r,
  CAST(((id * 37) % 100 + 100) % 100 AS DOUBLE) / 100 AS ml FROM pathed),
scored AS (SELECT *, coalesce(list_max(list_transform(r, lambda x: x.w)), 0.0) AS rule_score, CASE WHEN ml >= 0.95 THEN 0.75 WHEN ml >= 0.90 THEN 0.55 ELSE 0.0 END AS model FROM ruled),
final AS (SELECT *, round(CAST(CASE WHEN allowlisted AND rule_score < 0.40 THEN least(greatest(rule_score, model), 0.15) ELSE greatest(rule_score, model) END AS DOUBLE), 4) AS risk_score FROM scored)"""


_SUFFIX_SOURCE = SOURCE_SQL + " UNION ALL SELECT CAST(id AS BIGINT), url FROM (VALUES " + ", ".join(f"({-2000 - k}, {_quote(s)})" for k, s in enumerate(SUFFIX_SEEDS)) + ") AS more(id, url)"
_BY_TABLE = HOSTS_SQL.replace(SOURCE_SQL, _SUFFIX_SOURCE)
ORACLE = {
    "url_public_suffix": f"WITH {_BY_TABLE} SELECT id, host, subdomain, domain, suffix, registered FROM hosts",
    "url_hosts": f"WITH {HOSTS_SQL} SELECT id, text, host, subdomain, domain, suffix, registered FROM hosts",
    "url_validate": rf"""WITH {HOSTS_SQL}, c AS (SELECT h.id, h.text, t.url, t.t, string_split(split_part(split_part(split_part(regexp_replace(t.t, '^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?', ''), '/', 1), '?', 1), '#', 1), '@')[-1] AS h FROM hosts h JOIN trimmed t USING (id))
      SELECT id, text, CASE WHEN length(coalesce(url, '')) > 2048 THEN 'too long' WHEN t = '' THEN 'empty' WHEN NOT regexp_matches(split_part(h, ':', 1), '(?i)^(([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{{2,}}|([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}|localhost)$') THEN 'no host' END AS reject_reason FROM c""",
    "url_lexical_core": rf"""WITH {HOSTS_SQL} SELECT id, length(host) AS hostname_length, length(domain) AS domain_length, length(suffix) AS tld_length, len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) AS subdomain_count,
      round(coalesce(list_entropy(string_split(domain, '')), 0), 4) AS domain_entropy, round(coalesce(list_entropy(string_split(host, '')), 0), 4) AS hostname_entropy,
      len(regexp_extract_all(checked, '[0-9]')) AS count_digit, CASE WHEN checked = '' THEN 0.0 ELSE round(CAST(len(regexp_extract_all(checked, '[0-9]')) AS DOUBLE) / length(checked), 4) END AS digit_ratio,
      len(regexp_extract_all(checked, '-')) AS count_hyphen, CASE WHEN checked = '' THEN 0.0 ELSE round(CAST(len(regexp_extract_all(checked, '-')) AS DOUBLE) / length(checked), 4) END AS hyphen_ratio,
      CASE WHEN len(regexp_extract_all(domain, '\p{{L}}')) = 0 THEN 0.0 ELSE round(CAST(len(regexp_extract_all(domain, '[aeiou]')) AS DOUBLE) / len(regexp_extract_all(domain, '\p{{L}}')), 4) END AS vowel_ratio FROM hosts""",
    "url_runs_tokens": rf"""WITH {FEATURES_SQL} SELECT id, coalesce(list_max(list_transform(regexp_extract_all(domain, '[^\P{{L}}aeiou]+'), lambda x: length(x))), 0) AS longest_consonant_run,
      coalesce(list_max(list_transform(list_filter(list_distinct(string_split(domain, '')), lambda c: c <> ''), lambda c: list_max(list_transform(regexp_extract_all(domain, '[' || c || ']+'), lambda x: length(x))))), 0) AS max_char_repeat,
      greatest(len(regexp_extract_all(checked, '\d+|\D+')) - 1, 0) AS digit_letter_transitions, len(tokens) AS token_count,
      coalesce(round(CAST(list_sum(list_transform(tokens, lambda x: length(x))) AS DOUBLE) / nullif(len(tokens), 0), 2), 0.0) AS avg_token_length, coalesce(list_max(list_transform(tokens, lambda x: length(x))), 0) AS max_token_length FROM features""",
    "url_host_flags": f"WITH {FEATURES_SQL} SELECT id, has_ip_address, has_port, has_punycode, is_shortener, suspicious_tld, common_tld FROM features",
    "url_brand_match": f"WITH {FEATURES_SQL} SELECT id, brand, contains_brand, brand_impersonation, brand_edit_distance FROM features",
    "url_keyword_counts": f"WITH {FEATURES_SQL} SELECT id, phishing_keyword_count, has_phishing_keyword, judol_keyword_count, has_judol_keyword, judol_strong_count FROM features",
    "url_rules_fused": f"WITH {FUSED_SQL} SELECT id, coalesce(array_to_string(list_transform(r, lambda x: x.n), ','), '') AS rules_fired, allowlisted, risk_score, CASE WHEN risk_score >= 0.70 THEN 'Malicious' WHEN risk_score >= 0.40 THEN 'Suspicious' ELSE 'Safe' END AS threat_label FROM final",
    "url_explanations": f"""WITH {FUSED_SQL}, m AS (SELECT id, r, allowlisted, coalesce(list_max(list_transform(r, lambda x: x.w)), 0) AS top, CAST((id * 37 % 100 + 100) % 100 AS DOUBLE) / 100 AS ml FROM final),
      why AS (SELECT id, list_concat(list_transform(list_sort(list_transform(r, lambda x: {{'w': -x.w, 'o': x.o, 'n': x.n}})), lambda x: x.n), list_filter([CASE WHEN allowlisted AND top < 0.4 THEN 'popular' WHEN allowlisted THEN 'popular_but_flagged' END,
        CASE WHEN len(r) = 0 AND ml >= 0.6 THEN 'unusual_name' WHEN len(r) = 0 AND NOT allowlisted THEN 'nothing_found' END], lambda x: x IS NOT NULL)) AS y FROM m)
      SELECT id, coalesce(array_to_string(y, '>'), '') AS titles, len(y) AS n_reasons, coalesce(CASE y[1] {" ".join(f"WHEN {_quote(n)} THEN {_quote(r)}" for n, r in {**R.REASONS, **R.NOTES}.items())} END, '') AS first_reason FROM why""",
}

QUERIES = {f.__name__: f for f in (url_hosts, url_public_suffix, url_validate, url_lexical_core, url_runs_tokens, url_host_flags, url_brand_match, url_keyword_counts, url_rules_fused, url_explanations)}
