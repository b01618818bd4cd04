"""Pivot (V1–V8) and overview (L1–L6) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import overview as O
from reqlens.operators import pivot as V
from reqlens.plans import duck
from reqlens.plans.registry import normalized, r, register
from reqlens.sources.fixtures import requests_relation, with_requests

_GROUP_SQL = ("CASE WHEN status IS NULL THEN 'Unknown' WHEN status < 300 THEN '2xx' WHEN status < 400 THEN '3xx' "
              "WHEN status < 500 THEN '4xx' ELSE '5xx' END")


@register("v1_pivot_count", with_requests("""
SELECT client_ip AS "row", request_verb AS col, count(*) AS value FROM requests
WHERE client_ip IS NOT NULL AND request_verb IS NOT NULL GROUP BY 1, 2"""))
def v1_pivot_count(spark, sf):
    return V.pivot_long(requests_relation(spark, sf), "client_ip", "request_verb")


@register("v2_pivot_sum_time_top", with_requests(f"""
SELECT request_url AS "row", {duck.bucket('time', "INTERVAL '1 day'")} AS col,
       {r('sum(CAST(sent_bytes AS DOUBLE))', 'value')}
FROM requests WHERE request_url IN (
  SELECT request_url FROM requests WHERE request_url IS NOT NULL GROUP BY 1
  ORDER BY sum(sent_bytes) DESC NULLS LAST, request_url LIMIT 20)
  AND time IS NOT NULL GROUP BY 1, 2"""))
def v2_pivot_sum_time_top(spark, sf):
    return normalized(V.pivot_long(requests_relation(spark, sf), "request_url", "time", value="sent_bytes",
                                   agg="sum", interval="1d", row_filter="top:20:sum:sent_bytes"))


@register("v3_pivot_p95", with_requests(f"""
SELECT request_verb AS "row", {duck.bucket('time', "INTERVAL '6 hours'")} AS col,
       {r('quantile_cont(target_processing_time, 0.95)', 'value')}
FROM requests WHERE request_verb IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2"""))
def v3_pivot_p95(spark, sf):
    return normalized(V.pivot_long(requests_relation(spark, sf), "request_verb", "time",
                                   value="target_processing_time", agg="p95", interval="6h"))


@register("v3b_pivot_p95_sorted", with_requests(f"""
SELECT request_verb AS "row", {duck.bucket('time', "INTERVAL '6 hours'")} AS col,
       {r('quantile_cont(target_processing_time, 0.95)', 'value')}
FROM requests WHERE request_verb IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2"""))
def v3b_pivot_p95_sorted(spark, sf):
    return normalized(V.pivot_long(requests_relation(spark, sf), "request_verb", "time",
                                   value="target_processing_time", agg="p95", interval="6h", exact="sort"))


@register("v4_pivot_error_rate", with_requests(f"""
SELECT request_verb AS "row", {duck.bucket('time', "INTERVAL '1 day'")} AS col,
       {r('avg(CASE WHEN status >= 400 THEN 1.0 WHEN status IS NOT NULL THEN 0.0 END)', 'value')}
FROM requests WHERE request_verb IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2"""))
def v4_pivot_error_rate(spark, sf):
    return normalized(V.pivot_long(requests_relation(spark, sf), "request_verb", "time",
                                   value="error_rate", interval="1d"))


@register("v6_pivot_status_groups", with_requests(f"""
SELECT request_url AS "row", {_GROUP_SQL} AS col, count(*) AS value
FROM requests WHERE request_url IN (
  SELECT request_url FROM requests WHERE request_url IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, request_url
  LIMIT 10) AND status IS NOT NULL AND {_GROUP_SQL} IN ('2xx', '4xx', '5xx') GROUP BY 1, 2"""))
def v6_pivot_status_groups(spark, sf):
    return V.pivot_long(requests_relation(spark, sf), "request_url", "status", status_groups=["2xx", "4xx", "5xx"],
                        row_filter="top:10:count")


@register("v7_pivot_threshold_avg", with_requests(f"""
SELECT target_ip AS "row", request_verb AS col, {r('avg(CAST(received_bytes AS DOUBLE))', 'value')}
FROM requests WHERE received_bytes >= 500 AND target_ip IS NOT NULL AND request_verb IS NOT NULL GROUP BY 1, 2"""))
def v7_pivot_threshold_avg(spark, sf):
    return normalized(V.pivot_long(requests_relation(spark, sf), "target_ip", "request_verb",
                                   value="received_bytes", agg="avg", row_filter="threshold:received_bytes:>=:500"))


@register("v8_pivot_wide", with_requests(f"""
SELECT "row", CAST(coalesce(sum(value) FILTER (WHERE col = '2xx'), 0) AS BIGINT) AS "2xx",
       CAST(coalesce(sum(value) FILTER (WHERE col = '3xx'), 0) AS BIGINT) AS "3xx",
       CAST(coalesce(sum(value) FILTER (WHERE col = '4xx'), 0) AS BIGINT) AS "4xx",
       CAST(coalesce(sum(value) FILTER (WHERE col = '5xx'), 0) AS BIGINT) AS "5xx"
FROM (SELECT client_ip AS "row", {_GROUP_SQL} AS col, count(*) AS value FROM requests
      WHERE client_ip IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def v8_pivot_wide(spark, sf):
    long = V.pivot_long(requests_relation(spark, sf), "client_ip", "status", status_groups=[])
    return V.pivot_wide(long, values=["2xx", "3xx", "4xx", "5xx"])


@register("v8b_dense_grid", with_requests(f"""
SELECT s.row, s.col, coalesce(c.value, 0) AS value
FROM (SELECT "row", unnest(range(min(col), max(col) + INTERVAL 10 MINUTE, INTERVAL 10 MINUTE)) AS col FROM cells GROUP BY 1) s
LEFT JOIN cells c ON c.row = s.row AND c.col = s.col""", extra_ctes=f"""cells AS (
  SELECT request_verb AS "row", {duck.bucket('time', "INTERVAL '10 minutes'")} AS col, count(*) AS value
  FROM requests WHERE request_verb IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2)"""))
def v8b_dense_grid(spark, sf):
    long = V.pivot_long(requests_relation(spark, sf), "request_verb", "time", interval="10m")
    return V.dense_grid(long, "10m")


@register("l1_totals", with_requests(f"""
SELECT count(*) AS total_requests, CAST(coalesce(sum(sent_bytes), 0) AS BIGINT) AS total_bytes,
       {r("count(*) FILTER (WHERE CAST(status AS VARCHAR) LIKE '4%' OR CAST(status AS VARCHAR) LIKE '5%') "
          "* 100.0 / count(*)", "error_rate")},
       count(DISTINCT client_ip) AS unique_ips
FROM requests WHERE time IS NOT NULL"""))
def l1_totals(spark, sf):
    return normalized(O.totals(requests_relation(spark, sf)))


@register("l2_status_donut", with_requests("""
SELECT CASE WHEN s IN (SELECT s FROM c ORDER BY n DESC, s LIMIT 5) THEN s ELSE 'Other' END AS status,
       CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1""", extra_ctes="""c AS (
  SELECT coalesce(CAST(status AS VARCHAR), 'Unknown') AS s, count(*) AS n FROM requests
  WHERE time IS NOT NULL GROUP BY 1)"""))
def l2_status_donut(spark, sf):
    return O.status_donut(requests_relation(spark, sf))


@register("l3_top_uris", with_requests("""
SELECT split_part(coalesce(request_url, ''), '?', 1) AS uri, count(*) AS count FROM requests
WHERE time IS NOT NULL GROUP BY 1 ORDER BY count DESC, uri LIMIT 10"""))
def l3_top_uris(spark, sf):
    return O.top_uris(requests_relation(spark, sf))


@register("l4_top_ips", with_requests("""
SELECT coalesce(client_ip, 'unknown') AS ip, count(*) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM requests WHERE time IS NOT NULL), 1) AS share
FROM requests WHERE time IS NOT NULL GROUP BY 1 ORDER BY count DESC, ip LIMIT 50"""))
def l4_top_ips(spark, sf):
    return normalized(O.top_ips(requests_relation(spark, sf)))


@register("l5_rebucket", with_requests("""
SELECT s - (s % 60) AS bucket_start, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT CAST(floor(epoch_us(time) / 1000000) AS BIGINT) AS s, count(*) AS n FROM requests
  WHERE time IS NOT NULL GROUP BY 1) GROUP BY 1"""))
def l5_rebucket(spark, sf):
    return O.per_second_rebucket(requests_relation(spark, sf), interval="1min")


@register("l6_scatter_sample", with_requests("""
SELECT event_id, status FROM requests WHERE time IS NOT NULL AND target_processing_time > 0
ORDER BY md5('42|' || event_id), event_id LIMIT 400"""))
def l6_scatter_sample(spark, sf):
    return O.scatter_sample(requests_relation(spark, sf), ["event_id"], max_points=400).select("event_id", "status")
