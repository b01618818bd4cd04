"""Statistics queries (A1–A13) over the derived ``requests`` relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import stats
from reqlens.plans import duck
from reqlens.plans.registry import normalized, r, register
from reqlens.sources.fixtures import LINEITEM_REQUESTS_SQL, lineitem_requests, requests_relation, with_requests

PT = ["request_processing_time", "target_processing_time", "response_processing_time"]


def _metric_sql(col: str, prefix: str, metrics) -> list[str]:
    simple = {"avg": "avg", "sum": "sum", "std": "stddev_samp", "min": "min", "max": "max"}
    prob = {"median": 0.5, "p10": 0.1, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = []
    for m in metrics:
        if m in simple:
            out.append(r(f"{simple[m]}({col})", f"{prefix}_{m}"))
        else:
            out.append(r(f"quantile_cont({col}, {prob[m]})", f"{prefix}_{m}"))
    return out


@register("a1_url_counts", with_requests("""
SELECT split_part(request_url, '?', 1) AS url, count(*) AS count
FROM requests GROUP BY 1 HAVING count(*) BETWEEN 2 AND 1000000"""))
def a1_url_counts(spark, sf):
    return stats.url_counts(requests_relation(spark, sf), min_count=2, max_count=1000000)


@register("a2_uri_patterns", with_requests(f"""
SELECT {duck.generalize_url('url')} AS pattern, CAST(sum(n) AS BIGINT) AS count
FROM (SELECT split_part(request_url, '?', 1) AS url, count(*) AS n FROM requests GROUP BY 1)
GROUP BY 1 ORDER BY count DESC, pattern LIMIT 50"""))
def a2_uri_patterns(spark, sf):
    return stats.uri_patterns(requests_relation(spark, sf), max_patterns=50)


@register("a2b_uri_patterns_with_query", with_requests(f"""
SELECT {duck.generalize_url('request_url')} AS pattern, count(*) AS count
FROM requests GROUP BY 1 HAVING count(*) >= 3"""))
def a2b_uri_patterns_with_query(spark, sf):
    return stats.uri_patterns(requests_relation(spark, sf), include_params=True, min_count=3,
                              max_patterns=None)


_SUMMARY_SQL = ", ".join(
    ["count(*) AS total_requests", "count(DISTINCT request_url) AS unique_urls",
     "count(DISTINCT client_ip) AS unique_ips"]
    + _metric_sql("target_processing_time", "response_time", stats.SUMMARY_METRICS)
    + _metric_sql("sent_bytes", "sent_bytes", ("avg", "std"))
    + _metric_sql("received_bytes", "received_bytes", ("avg", "std")))


@register("a3_summary", with_requests(f"SELECT {_SUMMARY_SQL} FROM requests"))
def a3_summary(spark, sf):
    return normalized(stats.summary_stats(requests_relation(spark, sf),
                                          byte_fields=("sent_bytes", "received_bytes")))


@register("a4_status_distribution", with_requests("""
SELECT status, count(*) AS count FROM requests WHERE status IS NOT NULL GROUP BY status"""))
def a4_status_distribution(spark, sf):
    return stats.status_distribution(requests_relation(spark, sf), "status")


@register("a4b_url_status_codes", with_requests("""
SELECT request_url AS url,
       '{' || string_agg('"' || CAST(status AS VARCHAR) || '":' || CAST(n AS VARCHAR), ',' ORDER BY status) || '}'
         AS status_codes
FROM (SELECT request_url, status, count(*) AS n FROM requests
      WHERE status IS NOT NULL AND request_url IS NOT NULL GROUP BY 1, 2)
GROUP BY 1"""))
def a4b_url_status_codes(spark, sf):
    m = stats.status_map(requests_relation(spark, sf), "status", "request_url")
    return m.select(F.col("request_url").alias("url"), F.to_json("status_codes").alias("status_codes"))


_URL_SQL = ", ".join(["request_url AS url", "count(*) AS count"]
                     + _metric_sql("target_processing_time", "response_time", stats.URL_METRICS))


@register("a5_url_stats", with_requests(f"""
SELECT {_URL_SQL} FROM requests WHERE request_url IS NOT NULL GROUP BY request_url"""))
def a5_url_stats(spark, sf):
    return normalized(stats.url_stats(requests_relation(spark, sf)))


_PT_SQL = ", ".join(["request_url AS url", "count(*) AS count"]
                    + [s for f in PT for s in _metric_sql(f, f, stats.URL_METRICS)])


@register("a6_url_processing_stats", with_requests(f"""
SELECT {_PT_SQL} FROM requests WHERE request_url IS NOT NULL GROUP BY request_url"""))
def a6_url_processing_stats(spark, sf):
    return normalized(stats.url_stats(requests_relation(spark, sf), rt=None, processing_fields=PT))


@register("a7_url_top_by_p95", with_requests(f"""
SELECT * FROM (SELECT {_URL_SQL} FROM requests WHERE request_url IS NOT NULL GROUP BY request_url)
ORDER BY coalesce(response_time_p95, 0) DESC, url LIMIT 20"""))
def a7_url_top_by_p95(spark, sf):
    return normalized(stats.url_stats(requests_relation(spark, sf), sort_by="target_processing_time",
                                      sort_metric="p95", top_n=20))


@register("a8_time_stats", with_requests(f"""
SELECT {duck.bucket('time', "INTERVAL '10 minutes'")} AS time_bucket, count(*) AS count,
       count(*) FILTER (WHERE status >= 400) AS error_count,
       {r("count(*) FILTER (WHERE status >= 400) / count(*)", "error_rate")},
       {r("avg(target_processing_time)", "avg_response_time")},
       {r("quantile_cont(target_processing_time, 0.95)", "p95_response_time")}
FROM requests WHERE time IS NOT NULL GROUP BY 1"""))
def a8_time_stats(spark, sf):
    return normalized(stats.time_stats(requests_relation(spark, sf), interval="10m"))


@register("a9_ip_stats", with_requests(f"""
SELECT client_ip AS ip, count(*) AS count, count(*) FILTER (WHERE status >= 400) AS error_count,
       {r("avg(target_processing_time)", "avg_response_time")}
FROM requests WHERE client_ip IS NOT NULL GROUP BY 1 ORDER BY count DESC, ip LIMIT 100"""))
def a9_ip_stats(spark, sf):
    return normalized(stats.ip_stats(requests_relation(spark, sf), top=100))


_A10_SQL = with_requests(f"""
SELECT date_trunc('minute', time) AS time, count(*) AS request_count,
       count(*) FILTER (WHERE status >= 400) AS error_count,
       {r("count(*) FILTER (WHERE status >= 400) / count(*) * 100", "error_rate")},
       count(*) FILTER (WHERE status = 200) AS status_2xx,
       count(*) FILTER (WHERE status = 400) AS status_4xx,
       count(*) FILTER (WHERE status = 500) AS status_5xx,
       count(*) FILTER (WHERE status >= 200 AND status < 300) AS class_2xx,
       count(*) FILTER (WHERE status >= 400 AND status < 500) AS class_4xx,
       count(*) FILTER (WHERE status >= 500) AS class_5xx,
       {r("avg(target_processing_time)", "avg_response_time")},
       {r("quantile_cont(target_processing_time, 0.95)", "p95_response_time")},
       {r("quantile_cont(target_processing_time, 0.99)", "p99_response_time")}
FROM requests WHERE time IS NOT NULL GROUP BY 1""")


@register("a10_minute_table", _A10_SQL)
def a10_minute_table(spark, sf):
    return normalized(stats.minute_table(requests_relation(spark, sf)))


@register("a11_dashboard", with_requests(f"""
SELECT date_trunc('minute', time) AS time, count(*) AS request_count,
       {r("avg(target_processing_time * 1000.0)", "avg_response_time_ms")},
       count(*) FILTER (WHERE status >= 400) AS error_count,
       {r("avg(CASE WHEN status >= 400 THEN 1.0 WHEN status IS NOT NULL THEN 0.0 END) * 100", "error_rate")}
FROM requests WHERE time IS NOT NULL GROUP BY 1"""))
def a11_dashboard(spark, sf):
    return normalized(stats.dashboard_minutes(requests_relation(spark, sf), rt_unit="s"))


_BYTES_SQL = ", ".join(["request_url AS url", "count(*) AS count"]
                       + _metric_sql("sent_bytes", "sent_bytes", ("avg", "std"))
                       + _metric_sql("received_bytes", "received_bytes", ("avg", "std")))


@register("a13_url_byte_stats", with_requests(f"""
SELECT {_BYTES_SQL} FROM requests WHERE request_url IS NOT NULL GROUP BY request_url"""))
def a13_url_byte_stats(spark, sf):
    return normalized(stats.url_stats(requests_relation(spark, sf), rt=None,
                                      byte_fields=("sent_bytes", "received_bytes")))


_PT_BIG_SQL = ", ".join(["request_url AS url", "count(*) AS count"]
                        + _metric_sql("target_processing_time", "response_time", stats.URL_METRICS)
                        + [s for f in PT for s in _metric_sql(f, f, ("avg", "p95"))])


@register("a5b_url_stats_lineitem", f"""WITH requests AS ({LINEITEM_REQUESTS_SQL})
SELECT {_PT_BIG_SQL} FROM requests WHERE request_url IS NOT NULL GROUP BY request_url""")
def a5b_url_stats_lineitem(spark, sf):
    """A5+A6 over one request per lineitem row (~500 URLs): the bench's baseline comparison."""
    out = stats.url_stats(lineitem_requests(spark, sf), processing_fields=PT)  # one aggregation
    keep = ["url", "count"] + [f"response_time_{m}" for m in stats.URL_METRICS] + [
        f"{f}_{m}" for f in PT for m in ("avg", "p95")]
    return normalized(out.select(*keep))


@register("a5c_url_stats_sorted_quantiles", with_requests(f"""
SELECT {_URL_SQL} FROM requests WHERE request_url IS NOT NULL GROUP BY request_url"""))
def a5c_url_stats_sorted_quantiles(spark, sf):
    """A5 with exact quantiles computed by range-sorting (no group held in one task)."""
    return normalized(stats.url_stats(requests_relation(spark, sf), exact="sort"))


@register("a8b_time_stats_sorted_quantiles", with_requests(f"""
SELECT {duck.bucket('time', "INTERVAL '10 minutes'")} AS time_bucket, count(*) AS count,
       count(*) FILTER (WHERE status >= 400) AS error_count,
       {r("count(*) FILTER (WHERE status >= 400) / count(*)", "error_rate")},
       {r("avg(target_processing_time)", "avg_response_time")},
       {r("quantile_cont(target_processing_time, 0.95)", "p95_response_time")}
FROM requests WHERE time IS NOT NULL GROUP BY 1"""))
def a8b_time_stats_sorted_quantiles(spark, sf):
    return normalized(stats.time_stats(requests_relation(spark, sf), interval="10m", exact="sort"))


@register("a3b_summary_sorted_quantiles", with_requests(f"SELECT {_SUMMARY_SQL} FROM requests"))
def a3b_summary_sorted_quantiles(spark, sf):
    return normalized(stats.summary_stats(requests_relation(spark, sf),
                                          byte_fields=("sent_bytes", "received_bytes"), exact="sort"))



@register("a10b_minute_table_sorted_quantiles", _A10_SQL)
def a10b_minute_table_sorted_quantiles(spark, sf):
    return normalized(stats.minute_table(requests_relation(spark, sf), exact="sort"))

