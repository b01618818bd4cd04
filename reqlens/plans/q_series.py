"""Top-N series, scatter set and composite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import series as S
from reqlens.operators import stats
from reqlens.operators.filters import filter_urls
from reqlens.plans import duck
from reqlens.plans.q_exprs import P5_RULES
from reqlens.plans.registry import normalized, r, register
from reqlens.sources.fixtures import requests_relation, with_requests


def _label(url: str = "request_url", rules=None) -> str:
    return (f"CASE WHEN {url} IS NULL THEN 'Unknown' ELSE "
            f"{duck.rule_chain(url, rules, duck.generalize_url(url)) if rules else duck.generalize_url(url)} END")


def _top_count_sql(label_sql: str, interval: str, top_n: int) -> str:
    return with_requests(f"""
SELECT time_bucket, CASE WHEN label IN (SELECT label FROM lead) OR label = 'Unknown' THEN label ELSE 'Others' END
         AS label, CAST(sum(n) AS BIGINT) AS count
FROM cells GROUP BY 1, 2""", extra_ctes=f"""cells AS (
  SELECT {duck.bucket('time', interval)} AS time_bucket, {label_sql} AS label, count(*) AS n
  FROM requests WHERE time IS NOT NULL GROUP BY 1, 2),
lead AS (SELECT label FROM cells GROUP BY label ORDER BY sum(n) DESC, label LIMIT {top_n})""")


@register("t1_requests_per_uri", _top_count_sql(_label(), "INTERVAL '1 hour'", 10))
def t1_requests_per_uri(spark, sf):
    return S.requests_per_uri(requests_relation(spark, sf), interval="1h", top_n=10)


@register("t2_requests_per_target", _top_count_sql(
    "coalesce(target_ip || ':' || CAST(target_port AS VARCHAR), 'Unknown')", "INTERVAL '6 hours'", 5))
def t2_requests_per_target(spark, sf):
    return S.requests_per_target(requests_relation(spark, sf), interval="6h", top_n=5)


@register("t3_requests_per_client", _top_count_sql("coalesce(client_ip, 'Unknown')", "INTERVAL '1 day'", 10))
def t3_requests_per_client(spark, sf):
    return S.requests_per_client(requests_relation(spark, sf), interval="1d", top_n=10)


def _bytes_cells_sql(col: str, top_n: int) -> str:
    return f"""cells AS (
  SELECT {duck.bucket('time', "INTERVAL '1 day'")} AS time_bucket, {_label()} AS label,
         sum(CAST({col} AS DOUBLE)) AS sum_bytes, avg(CAST({col} AS DOUBLE)) AS avg_bytes
  FROM requests WHERE time IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2),
lead AS (SELECT label FROM cells GROUP BY label ORDER BY sum(sum_bytes) DESC, label LIMIT {top_n})"""


@register("t4_received_bytes_cells", with_requests(f"""
SELECT time_bucket, label, {r('sum_bytes', 'sum_bytes')}, {r('avg_bytes', 'avg_bytes')}
FROM cells WHERE label IN (SELECT label FROM lead)""", extra_ctes=_bytes_cells_sql("received_bytes", 5)))
def t4_received_bytes_cells(spark, sf):
    cells, _ = S.bytes_per_uri(requests_relation(spark, sf), "received_bytes", interval="1d", top_n=5)
    return normalized(cells)


@register("t4b_received_bytes_ranking", with_requests(f"""
SELECT label, {r('total_sum', 'total_sum')}, {r('mean_avg', 'mean_avg')},
       CAST(row_number() OVER (ORDER BY total_sum DESC, label) AS INTEGER) AS rank_sum,
       CAST(row_number() OVER (ORDER BY mean_avg DESC, label) AS INTEGER) AS rank_avg
FROM (SELECT label, sum(sum_bytes) AS total_sum, avg(avg_bytes) AS mean_avg
      FROM cells WHERE label IN (SELECT label FROM lead) GROUP BY label)""",
      extra_ctes=_bytes_cells_sql("received_bytes", 5)))
def t4b_received_bytes_ranking(spark, sf):
    _, rank = S.bytes_per_uri(requests_relation(spark, sf), "received_bytes", interval="1d", top_n=5)
    return normalized(rank)


@register("t5_sent_bytes_cells", with_requests(f"""
SELECT time_bucket, label, {r('sum_bytes', 'sum_bytes')}, {r('avg_bytes', 'avg_bytes')}
FROM cells WHERE label IN (SELECT label FROM lead)""", extra_ctes=_bytes_cells_sql("sent_bytes", 5)))
def t5_sent_bytes_cells(spark, sf):
    cells, _ = S.bytes_per_uri(requests_relation(spark, sf), "sent_bytes", interval="1d", top_n=5)
    return normalized(cells)


def _pt_sql(agg_sql: str, top_n: int) -> str:
    return with_requests(f"""
SELECT time_bucket, label, {r(agg_sql, 'value')} FROM (
  SELECT time_bucket, CASE WHEN label IN (SELECT label FROM lead) OR label = 'Unknown' THEN label
                           ELSE 'Others' END AS label, v FROM rows_)
GROUP BY 1, 2""", extra_ctes=f"""rows_ AS (
  SELECT {duck.bucket('time', "INTERVAL '1 day'")} AS time_bucket, {_label()} AS label,
         CAST(target_processing_time AS DOUBLE) AS v
  FROM requests WHERE time IS NOT NULL AND target_processing_time IS NOT NULL),
lead AS (SELECT label FROM rows_ GROUP BY label ORDER BY sum(v) DESC, label LIMIT {top_n})""")


@register("t6_processing_time_p95", _pt_sql("quantile_cont(v, 0.95)", 5))
def t6_processing_time_p95(spark, sf):
    return normalized(S.processing_time_per_uri(requests_relation(spark, sf), metric="p95",
                                                interval="1d", top_n=5))


@register("t6c_processing_time_p95_sorted", _pt_sql("quantile_cont(v, 0.95)", 5))
def t6c_processing_time_p95_sorted(spark, sf):
    return normalized(S.processing_time_per_uri(requests_relation(spark, sf), metric="p95",
                                                interval="1d", top_n=5, exact="sort"))


@register("t6b_processing_time_avg", _pt_sql("avg(v)", 5))
def t6b_processing_time_avg(spark, sf):
    return normalized(S.processing_time_per_uri(requests_relation(spark, sf), metric="avg",
                                                interval="1d", top_n=5))


_RULE_LEADS_SQL = ("SELECT DISTINCT " + _label("rep", P5_RULES) + " AS label FROM (VALUES "
                   + ", ".join(f"({duck.sql_str(x.replacement)})" for x in P5_RULES) + ") t(rep)")


@register("t7_rule_series", with_requests(f"""
SELECT time_bucket, CASE WHEN label IN (SELECT label FROM lead) OR label = 'Unknown' THEN label ELSE 'Others' END
         AS label, CAST(sum(n) AS BIGINT) AS count
FROM cells GROUP BY 1, 2""", extra_ctes=f"""cells AS (
  SELECT {duck.bucket('time', "INTERVAL '1 day'")} AS time_bucket, {_label('request_url', P5_RULES)} AS label,
         count(*) AS n
  FROM requests WHERE time IS NOT NULL GROUP BY 1, 2),
lead AS ({_RULE_LEADS_SQL})"""))
def t7_rule_series(spark, sf):
    return S.requests_per_uri(requests_relation(spark, sf), interval="1d", rules=P5_RULES)


_T7_LABELS = ["/blog-en/*", "/paged", "/static/*", "Others", "Unknown"]


@register("t7b_rule_series_wide", with_requests(f"""
SELECT time_bucket, {", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE label = {duck.sql_str(x)}), 0) AS BIGINT) AS "
                               + chr(34) + x + chr(34) for x in _T7_LABELS)}
FROM (SELECT time_bucket, CASE WHEN label IN (SELECT label FROM lead) OR label = 'Unknown' THEN label
                               ELSE 'Others' END AS label, n FROM cells)
GROUP BY 1""", extra_ctes=f"""cells AS (
  SELECT {duck.bucket('time', "INTERVAL '1 day'")} AS time_bucket, {_label('request_url', P5_RULES)} AS label,
         count(*) AS n
  FROM requests WHERE time IS NOT NULL GROUP BY 1, 2),
lead AS ({_RULE_LEADS_SQL})"""))
def t7b_rule_series_wide(spark, sf):
    cells = S.requests_per_uri(requests_relation(spark, sf), interval="1d", rules=P5_RULES)
    return S.series_wide(cells, "count", _T7_LABELS)


# Python's re.escape special characters (minus '*', which becomes '.*')
_ESC = r"([()\[\]{}?+|^$\\.&~# \t\n\r" + "\x0b\x0c" + r"-])"


@register("t8_rule_store", with_requests(f"""
SELECT CAST(row_number() OVER (ORDER BY src, o, replacement) - 1 AS INTEGER) AS ord, pattern, replacement FROM (
  SELECT replacement, arg_min(pattern, src * 1000000 + o) AS pattern, min(src * 1000000 + o) // 1000000 AS src,
         min(src * 1000000 + o) % 1000000 AS o
  FROM (
    SELECT 0 AS src, o, pattern, replacement FROM (VALUES {", ".join(
        f"({i}, {duck.sql_str(x.pattern)}, {duck.sql_str(x.replacement)})" for i, x in enumerate(P5_RULES))})
      t(o, pattern, replacement)
    UNION ALL
    SELECT 1 AS src, CAST(row_number() OVER (ORDER BY total DESC, label) - 1 AS INTEGER) AS o,
           '^' || replace(regexp_replace(label, {duck.sql_str(_ESC)}, '\\\\\\1', 'g'), '*', '.*') || '$' AS pattern,
           label AS replacement
    FROM (SELECT label, sum(n) AS total FROM cells GROUP BY label ORDER BY total DESC, label LIMIT 8)
    WHERE label NOT IN ('Others', 'Unknown'))
  WHERE replacement IS NOT NULL AND replacement <> ''
  GROUP BY replacement)""", extra_ctes=f"""cells AS (
  SELECT {_label()} AS label, count(*) AS n FROM requests WHERE time IS NOT NULL GROUP BY 1)"""))
def t8_rule_store(spark, sf):
    req = requests_relation(spark, sf).filter(F.col("time").isNotNull())
    cells = req.groupBy(S.url_pattern_label(F.col("request_url")).alias(S.LABEL)).agg(
        F.count(F.lit(1)).alias("count"))
    lead = S.leaders(cells, "count", 8)
    store = spark.createDataFrame([(i, x.pattern, x.replacement) for i, x in enumerate(P5_RULES)],
                                  "ord INT, pattern STRING, replacement STRING")
    return S.update_rule_store(spark, store, lead)


@register("t9_scatter_status", with_requests(f"""
SELECT event_id, time, {r('target_processing_time * 1000.0', 'response_ms')}, status,
       CASE WHEN status IS NULL THEN 'unknown' WHEN status < 300 THEN 'success' WHEN status < 400 THEN 'redirect'
            WHEN status < 500 THEN 'client_error' ELSE 'server_error' END AS status_class,
       CASE WHEN status IS NULL THEN 'unknown' WHEN status < 300 THEN 'success' WHEN status < 400 THEN 'redirect'
            WHEN status < 500 THEN 'client_error' ELSE 'server_error' END AS "group"
FROM requests WHERE time IS NOT NULL AND target_processing_time IS NOT NULL"""))
def t9_scatter_status(spark, sf):
    return normalized(S.scatter_points(requests_relation(spark, sf), keep=["event_id"]))


@register("t10_scatter_url_groups", with_requests("""
SELECT CASE WHEN request_url IS NULL THEN 'Unknown' WHEN length(request_url) > 50
            THEN substr(request_url, 1, 47) || '...' ELSE request_url END AS "group", count(*) AS count
FROM requests WHERE time IS NOT NULL AND target_processing_time IS NOT NULL GROUP BY 1"""))
def t10_scatter_url_groups(spark, sf):
    pts = S.scatter_points(requests_relation(spark, sf), group_by="url")
    return S.group_sizes(pts)


@register("t11_scatter_target_ip", with_requests("""
SELECT event_id, target_ip AS "group" FROM requests
WHERE time IS NOT NULL AND target_processing_time IS NOT NULL AND target_ip IS NOT NULL"""))
def t11_scatter_target_ip(spark, sf):
    pts = S.scatter_points(requests_relation(spark, sf), group_by="ip", keep=["event_id"])
    return pts.select("event_id", "group")


_CAP = 300       # under the row count at every scale


_SAMPLE_SQL = "ORDER BY md5('42|' || event_id), event_id LIMIT"


@register("t12_downsample", with_requests(f"""
SELECT event_id, status FROM requests WHERE time IS NOT NULL AND target_processing_time IS NOT NULL {_SAMPLE_SQL} {_CAP}"""))
def t12_downsample(spark, sf):
    pts = S.scatter_points(requests_relation(spark, sf), keep=["event_id"])
    return S.downsample(pts, ["event_id"], max_points=_CAP).select("event_id", "status")


@register("t13_scatter_counters", with_requests("""
SELECT (SELECT count(*) FROM requests) AS original_rows, count(*) AS plotted_rows,
       count(DISTINCT CASE WHEN status IS NULL THEN 'unknown' WHEN status < 300 THEN 'success'
                           WHEN status < 400 THEN 'redirect' WHEN status < 500 THEN 'client_error'
                           ELSE 'server_error' END) AS distinct_groups,
       0 AS patterns_applied
FROM requests WHERE time IS NOT NULL AND target_processing_time IS NOT NULL"""))
def t13_scatter_counters(spark, sf):
    """Counters of the whole chart: every point is plotted."""
    req = requests_relation(spark, sf)
    pts = S.scatter_points(req, keep=["event_id"])
    return S.scatter_counters(req, S.downsample(pts, ["event_id"], None))


@register("t14_display_ranking", with_requests("""
SELECT label, CAST(total AS BIGINT) AS total, display_rank FROM (
  SELECT label, total, CAST(row_number() OVER (ORDER BY total DESC, label) AS INTEGER) AS display_rank FROM (
    SELECT label, sum(count) AS total FROM t1 WHERE label <> 'Others' GROUP BY label
    ORDER BY total DESC, label LIMIT 10))
UNION ALL SELECT label, CAST(sum(count) AS BIGINT), 11 FROM t1 WHERE label = 'Others' GROUP BY label""",
      extra_ctes=f"""cells AS (
  SELECT {duck.bucket('time', "INTERVAL '1 hour'")} AS time_bucket, {_label()} AS label, count(*) AS n
  FROM requests WHERE time IS NOT NULL GROUP BY 1, 2),
lead AS (SELECT label FROM cells GROUP BY label ORDER BY sum(n) DESC, label LIMIT 10),
t1 AS (SELECT time_bucket, CASE WHEN label IN (SELECT label FROM lead) OR label = 'Unknown' THEN label
                                ELSE 'Others' END AS label, sum(n) AS count FROM cells GROUP BY 1, 2)"""))
def t14_display_ranking(spark, sf):
    t1 = S.requests_per_uri(requests_relation(spark, sf), interval="1h", top_n=10)
    return S.display_ranking(t1, "count", top_n=10).withColumn("total", F.col("total").cast("bigint"))


@register("c1_slowest_urls_scatter", with_requests(f"""
SELECT event_id, request_url, {r('target_processing_time * 1000.0', 'response_ms')}
FROM requests WHERE time IS NOT NULL AND target_processing_time IS NOT NULL AND request_url IN (
  SELECT request_url FROM requests WHERE request_url IS NOT NULL GROUP BY 1
  ORDER BY coalesce(avg(target_processing_time), 0) DESC, request_url LIMIT 5)"""))
def c1_slowest_urls_scatter(spark, sf):
    req = requests_relation(spark, sf)
    top = stats.url_stats(req, sort_by="target_processing_time", sort_metric="avg", top_n=5).select("url")
    pts = S.scatter_points(filter_urls(req, top), keep=["event_id", "request_url"])
    return normalized(pts.select("event_id", "request_url", "response_ms"))
