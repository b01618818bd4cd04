"""Expression queries.

URL expressions run over ``url_variants``: every page URL plus five variants
derived from the page row (a long hex segment, a UUID path, a static file, a
mostly-digit id with a query, a trailing slash), so all branches of the
generalisation are exercised on data that grows with ``pages``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.functions import exprs as X
from reqlens.functions import urls as U
from reqlens.functions.rule_index import with_pattern
from reqlens.operators import stats
from reqlens.plans import duck
from reqlens.plans.registry import normalized, r, register
from reqlens.sources.fixtures import requests_relation, table, with_requests

# Fixed test parameters: file extensions cycled over pages, and a rule list.
VARIANT_EXTS = ["PNG", "css", "woff2", "mp4", "json", "tar", "htm", "xyz", "docx", "flac"]
P5_RULES = [
    U.Rule(r"https://blog\.[^/]+/en/.*", "/blog-en/*"),
    U.Rule(r".*\?page=2", "/paged"),
    U.Rule(r"/static/.*", "/static/*"),
]


def url_variants(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    pid = F.col("page_id")
    h = F.md5(F.col("url"))
    ext = F.element_at(F.array(*[F.lit(e) for e in VARIANT_EXTS]), (pid % 10 + 1).cast("int"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    variants = F.array(
        F.col("url"),
        F.concat(U.strip_query(F.col("url")), F.lit("/"), h),
        F.concat(F.lit("/users/"), uuid, F.lit("/profile")),
        F.concat(F.lit("/static/img"), pid.cast("string"), F.lit("."), ext),
        F.concat(F.lit("/orders/A"), F.lpad((pid * 7919).cast("string"), 9, "0"), F.lit("?x="),
                 pid.cast("string")),
        F.concat(F.lit("/items/"), pid.cast("string"), F.lit("/")),
    )
    return p.select("page_id", F.posexplode(variants).alias("kind", "url"))


_EXTS_SQL = "[" + ", ".join(duck.sql_str(e) for e in VARIANT_EXTS) + "]"
VARIANTS_CTE = f"""url_variants AS (
  SELECT page_id, CAST(unnest(range(6)) AS INTEGER) AS kind, unnest([
    url,
    split_part(url, '?', 1) || '/' || md5(url),
    '/users/' || substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4)
      || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) || '/profile',
    '/static/img' || CAST(page_id AS VARCHAR) || '.' || {_EXTS_SQL}[page_id % 10 + 1],
    '/orders/A' || lpad(CAST(page_id * 7919 AS VARCHAR), 9, '0') || '?x=' || CAST(page_id AS VARCHAR),
    '/items/' || CAST(page_id AS VARCHAR) || '/']) AS url
  FROM pages)"""


def _variants_sql(body: str) -> str:
    return f"WITH {VARIANTS_CTE}\n{body}"


@register("p1_strip_query", with_requests(
    "SELECT event_id, split_part(request_url, '?', 1) AS url FROM requests"))
def p1_strip_query(spark, sf):
    return requests_relation(spark, sf).select("event_id", U.strip_query(F.col("request_url")).alias("url"))


@register("p2_generalize_url", _variants_sql(
    f"SELECT page_id, kind, url, {duck.generalize_url('url')} AS pattern FROM url_variants"))
def p2_generalize_url(spark, sf):
    v = url_variants(spark, sf)
    return v.select("page_id", "kind", "url", U.generalize_url(F.col("url")).alias("pattern"))


@register("p3_static_category", _variants_sql(f"""
SELECT page_id, kind, seg AS segment, {duck.static_category('seg')} AS category
FROM (SELECT page_id, kind, regexp_extract(split_part(url, '?', 1), '[^/]*$') AS seg FROM url_variants)"""))
def p3_static_category(spark, sf):
    v = url_variants(spark, sf)
    seg = F.substring_index(U.strip_query(F.col("url")), "/", -1)
    return v.select("page_id", "kind", seg.alias("segment"), U.static_category(seg).alias("category"))


@register("p4_id_like_segments", _variants_sql(f"""
SELECT seg AS segment, {duck.id_like('seg')} AS id_like
FROM (SELECT DISTINCT unnest(string_split(split_part(url, '?', 1), '/')) AS seg FROM url_variants)
WHERE seg <> ''"""))
def p4_id_like_segments(spark, sf):
    v = url_variants(spark, sf)
    segs = v.select(F.explode(F.split(U.strip_query(F.col("url")), "/", -1)).alias("segment")) \
        .filter(F.col("segment") != "").distinct()
    return segs.select("segment", U.is_id_like(F.col("segment")).alias("id_like"))


@register("p5_generalize_with_rules", _variants_sql(f"""
SELECT page_id, kind, {duck.rule_chain('url', P5_RULES, duck.generalize_url('url'))} AS pattern
FROM url_variants"""))
def p5_generalize_with_rules(spark, sf):
    v = url_variants(spark, sf)
    return v.select("page_id", "kind", U.generalize_with_rules(F.col("url"), P5_RULES).alias("pattern"))


_TOP_PATTERNS_SQL = f"""
SELECT pattern, row_number() OVER (ORDER BY count DESC, pattern) AS ord FROM (
  SELECT {duck.generalize_url('url')} AS pattern, CAST(sum(n) AS BIGINT) AS count
  FROM (SELECT split_part(request_url, '?', 1) AS url, count(*) AS n FROM requests GROUP BY 1)
  GROUP BY 1 ORDER BY count DESC, pattern LIMIT 10)"""


@register("p6_wildcard_rules", with_requests(r"""
SELECT u.url,
       (SELECT p.pattern FROM top_patterns p
        WHERE u.url LIKE replace(replace(replace(replace(p.pattern, '\', '\\'), '%', '\%'), '_', '\_'), '*', '%')
              ESCAPE '\'
        ORDER BY p.ord LIMIT 1) AS rule_pattern
FROM (SELECT DISTINCT split_part(request_url, '?', 1) AS url FROM requests) u""",
      extra_ctes=f"top_patterns AS ({_TOP_PATTERNS_SQL})"))
def p6_wildcard_rules(spark, sf):
    req = requests_relation(spark, sf)
    leaders = stats.uri_patterns(req, max_patterns=10)
    rules = U.rules_from_patterns([row["pattern"] for row in leaders.collect()])
    urls = req.select(U.strip_query(F.col("request_url")).alias("url")).distinct()
    return urls.select("url", U.rule_label(F.col("url"), rules).alias("rule_pattern"))


# rules made by count: the longest number first, three languages
MANY_RULES = U.rules_from_patterns([f"*/{lang}/{n}*" for lang in ("en", "de", "es") for n in range(799, -1, -1)])


@register("p5c_many_rules", with_requests(f"""
SELECT u.url, u.n, coalesce(min_by(r.pattern, r.ord), {duck.generalize_url('u.url')}) AS label
FROM (SELECT request_url AS url, count(*) AS n FROM requests GROUP BY 1) u
LEFT JOIN (SELECT l.ord * 800 + 799 - n AS ord, '*/' || l.lang || '/' || n || '*' AS pattern
           FROM (VALUES (0, 'en'), (1, 'de'), (2, 'es')) l(ord, lang), range(800) t(n)) r ON u.url LIKE replace(r.pattern, '*', '%')
GROUP BY 1, 2"""))
def p5c_many_rules(spark, sf):
    """2,400 rules through the rule index, per distinct URL."""
    urls = requests_relation(spark, sf).groupBy(F.col("request_url").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    return with_pattern(urls, "url", MANY_RULES, "label")


@register("p7_scatter_label", with_requests("""
SELECT DISTINCT request_url AS url,
       CASE WHEN request_url IS NULL THEN 'Unknown'
            WHEN length(request_url) > 50 THEN substr(request_url, 1, 47) || '...'
            ELSE request_url END AS label
FROM requests"""))
def p7_scatter_label(spark, sf):
    req = requests_relation(spark, sf).select("request_url").distinct()
    return req.select(F.col("request_url").alias("url"), U.scatter_label(F.col("request_url")).alias("label"))


@register("p8_p9_status_class_group", with_requests("""
SELECT event_id, status,
       CASE WHEN status IS NULL THEN 'unknown' WHEN status < 300 THEN 'success'
            WHEN status < 400 THEN 'redirect' WHEN status < 500 THEN 'client_error'
            ELSE 'server_error' END AS status_class,
       CASE WHEN status IS NULL THEN 'Unknown' WHEN status < 300 THEN '2xx' WHEN status < 400 THEN '3xx'
            WHEN status < 500 THEN '4xx' ELSE '5xx' END AS status_group
FROM requests"""))
def p8_p9_status_class_group(spark, sf):
    req = requests_relation(spark, sf)
    return req.select("event_id", "status", X.status_class(F.col("status")).alias("status_class"),
                      X.status_group(F.col("status")).alias("status_group"))


@register("p10_time_buckets", with_requests(f"""
SELECT event_id,
       {duck.bucket('time', "INTERVAL '30 seconds'")} AS b_30s,
       {duck.bucket('time', "INTERVAL '7 minutes'")} AS b_7m,
       {duck.bucket('time', "INTERVAL '1 hour'")} AS b_1h,
       {duck.bucket('time', "INTERVAL '1 day'")} AS b_1d
FROM requests"""))
def p10_time_buckets(spark, sf):
    req = requests_relation(spark, sf)
    b = {k: X.bucket_of(req, "time", iv) for k, iv in
         [("b_30s", "30s"), ("b_7m", "7min"), ("b_1h", "1h"), ("b_1d", "1days")]}
    return req.select("event_id", *[c.alias(k) for k, c in b.items()])


@register("p12_p15_time_columns", with_requests(f"""
SELECT event_id, {r("target_processing_time * 1000.0", "target_ms")},
       {r("coalesce(request_processing_time, 0) + coalesce(target_processing_time, 0) "
          "+ coalesce(response_processing_time, 0)", "total_time")}
FROM requests"""))
def p12_p15_time_columns(spark, sf):
    req = requests_relation(spark, sf)
    return normalized(req.select(
        "event_id", X.to_millis(F.col("target_processing_time"), "s").alias("target_ms"),
        X.total_alb_time(F.col("request_processing_time"), F.col("target_processing_time"),
                         F.col("response_processing_time")).alias("total_time")))


@register("p13_p14_labels", with_requests("""
SELECT event_id, coalesce(target_ip || ':' || CAST(target_port AS VARCHAR), 'Unknown') AS target,
       coalesce(client_ip, 'Unknown') AS client
FROM requests"""))
def p13_p14_labels(spark, sf):
    req = requests_relation(spark, sf)
    return req.select("event_id", X.target_key(F.col("target_ip"), F.col("target_port")).alias("target"),
                      X.client_label(F.col("client_ip")).alias("client"))


def _size_label_sql(b: str) -> str:
    parts = []
    for k, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        d = 1024 ** k
        q = (f"((({b}) * 10) // {d} + CASE WHEN 2 * ((({b}) * 10) % {d}) > {d} THEN 1 "
             f"WHEN 2 * ((({b}) * 10) % {d}) = {d} AND ((({b}) * 10) // {d}) % 2 = 1 THEN 1 ELSE 0 END)")
        text = f"CAST({q} // 10 AS VARCHAR) || '.' || CAST({q} % 10 AS VARCHAR) || '{unit}'"
        cond = f"({b}) < {1024 ** (k + 1)}" if unit != "TB" else "TRUE"
        parts.append(f"WHEN {cond} THEN {text}")
    return f"(CASE WHEN ({b}) IS NULL THEN NULL {' '.join(parts)} END)"


@register("p17_size_labels", with_requests(f"""
SELECT url, scale, {_size_label_sql('total * scale')} AS size
FROM (SELECT request_url AS url, CAST(sum(sent_bytes) AS BIGINT) AS total FROM requests GROUP BY 1),
     (SELECT unnest([1, 3, 1000, 1000000, 1000000000, 1000000000000]) AS scale)"""))
def p17_size_labels(spark, sf):
    req = requests_relation(spark, sf)
    per = req.groupBy(F.col("request_url").alias("url")).agg(F.sum("sent_bytes").alias("total"))
    scales = F.explode(F.array(*[F.lit(x).cast("bigint") for x in
                                 [1, 3, 1000, 1000000, 1000000000, 1000000000000]])).alias("scale")
    per = per.select("url", "total", scales)
    return per.select("url", "scale", X.size_label(F.col("total") * F.col("scale")).alias("size"))
