"""Sink round trips (K1–K8) and the streaming window count."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from reqlens.functions.urls import rules_from_patterns
from reqlens.operators import filters as FL
from reqlens.operators import pivot as V
from reqlens.operators import stats
from reqlens.operators.rules import merge_rules
from reqlens.plans import duck
from reqlens.plans.q_exprs import P5_RULES
from reqlens.plans.q_sources import _sql, duck_parse, land_lines
from reqlens.plans.registry import normalized, r, register
from reqlens.session import shared_dir
from reqlens.sinks import writers as W
from reqlens.sources.fixtures import requests_relation, with_requests
from reqlens.sources.formats import PRESETS
from reqlens.streaming.live import live_window_counts, read_window_counts

_REQ_SCHEMA = ("event_id BIGINT, time TIMESTAMP_NTZ, client_ip STRING, request_url STRING, status INT, "
               "target_processing_time DOUBLE, sent_bytes BIGINT")
_REQ_COLS = [c.split()[0] for c in _REQ_SCHEMA.split(", ")]


@register("k1_filtered_json_roundtrip", with_requests(f"""
SELECT event_id, time, client_ip, request_url, status, {r('target_processing_time', 'target_processing_time')},
       sent_bytes FROM requests WHERE status >= 500 AND status < 600"""))
def k1_filtered_json_roundtrip(spark, sf):
    req = FL.filter_status(requests_relation(spark, sf), "5xx").select(*_REQ_COLS)
    path = W.write_json_lines(req, shared_dir(spark, "filtered"))
    return normalized(W.read_json_lines(spark, path, _REQ_SCHEMA))


@register("k2_stats_sections_json", with_requests(f"""
SELECT request_url AS url, count(*) AS count, {r('avg(target_processing_time)', 'response_time_avg')},
       {r('quantile_cont(target_processing_time, 0.95)', 'response_time_p95')}
FROM requests WHERE request_url IS NOT NULL GROUP BY 1"""))
def k2_stats_sections_json(spark, sf):
    secs = stats.calculate_stats(requests_relation(spark, sf), ["url", "time"])
    paths = W.write_sections({k: v for k, v in secs.items()}, shared_dir(spark, "stats"))
    back = spark.read.json(paths["url_stats"])
    return normalized(back.select("url", "count", "response_time_avg", "response_time_p95"))


@register("k3_url_list_json", with_requests("""
SELECT split_part(request_url, '?', 1) AS url, count(*) AS count FROM requests GROUP BY 1"""))
def k3_url_list_json(spark, sf):
    urls = stats.url_counts(requests_relation(spark, sf))
    path = W.write_json_lines(urls, shared_dir(spark, "urls"))
    return W.read_json_lines(spark, path, "url STRING, count BIGINT")


@register("k4_csv_roundtrip", with_requests(f"""
SELECT event_id, time, client_ip, request_url, status, {r('target_processing_time', 'target_processing_time')},
       sent_bytes FROM requests"""))
def k4_csv_roundtrip(spark, sf):
    req = requests_relation(spark, sf).select(*_REQ_COLS)
    path = W.write_csv(req, shared_dir(spark, "export"), sep=";", encoding="utf-8")
    return normalized(W.read_csv(spark, path, _REQ_SCHEMA, sep=";"))


@register("k5_table_roundtrip", with_requests("""
SELECT client_ip AS ip, count(*) AS count FROM requests WHERE client_ip IS NOT NULL GROUP BY 1"""))
def k5_table_roundtrip(spark, sf):
    d = requests_relation(spark, sf).filter(F.col("client_ip").isNotNull()).groupBy(
        F.col("client_ip").alias("ip")).agg(F.count(F.lit(1)).alias("count"))
    path = shared_dir(spark, "table")
    name = "reqlens_ip_counts_" + os.path.basename(path).split("-")[-1]
    W.save_table(d, name, path)
    return W.load_table(spark, name)


@register("k6_parquet_snapshot", with_requests(f"""
SELECT event_id, time, client_ip, request_url, status, {r('target_processing_time', 'target_processing_time')},
       sent_bytes, CAST(time AS DATE) AS day FROM requests"""))
def k6_parquet_snapshot(spark, sf):
    req = requests_relation(spark, sf).select(*_REQ_COLS).withColumn("day", F.to_date("time"))
    path = W.save_snapshot(req, shared_dir(spark, "snapshot"), partition_by=["day"])
    return normalized(W.load_snapshot(spark, path))


@register("k6b_time_filter_on_day_partitions", with_requests("""
SELECT event_id, time FROM requests
WHERE time >= TIMESTAMP '2024-01-03 00:00:00' AND time <= TIMESTAMP '2024-01-05 12:00:00'"""))
def k6b_time_filter_on_day_partitions(spark, sf):
    """F1 over a day-partitioned snapshot: the bounds also prune partitions."""
    req = requests_relation(spark, sf).select(*_REQ_COLS).withColumn("day", F.to_date("time"))
    snap = W.load_snapshot(spark, W.save_snapshot(req, shared_dir(spark, "snapshot"), partition_by=["day"]))
    return FL.filter_time(snap, "2024-01-03T00:00:00", "2024-01-05T21:00:00+09:00").select("event_id", "time")


@register("k7_pivot_json", with_requests(f"""
SELECT request_verb AS "row", {duck.bucket('time', "INTERVAL '1 day'")} AS col, count(*) AS value
FROM requests WHERE request_verb IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2"""))
def k7_pivot_json(spark, sf):
    long = V.pivot_long(requests_relation(spark, sf), "request_verb", "time", interval="1d")
    path = W.write_json_lines(long, shared_dir(spark, "pivot"))
    return W.read_json_lines(spark, path, "row STRING, col TIMESTAMP_NTZ, value BIGINT")


# the characters that a literal part of a rule escapes
_ESC = r"([()\[\]{}?+|^$\\.&~# \t\n\r" + "\x0b\x0c" + r"-])"


def _top_pattern_rules_sql() -> str:
    return f"""
SELECT pattern AS replacement, CAST(row_number() OVER (ORDER BY count DESC, pattern) - 1 AS INTEGER) AS o FROM (
  SELECT {duck.generalize_url('url')} AS pattern, CAST(sum(n) AS BIGINT) AS count
  FROM (SELECT split_part(request_url, '?', 1) AS url, count(*) AS n FROM requests GROUP BY 1)
  GROUP BY 1 ORDER BY count DESC, pattern LIMIT 6)"""


@register("k8_rule_file_roundtrip", with_requests(f"""
SELECT CAST(row_number() OVER (ORDER BY src, o, replacement) - 1 AS INTEGER) AS ord, pattern, replacement FROM (
  SELECT replacement, arg_min(pattern, src * 1000000 + o) AS pattern,
         min(src * 1000000 + o) // 1000000 AS src, min(src * 1000000 + o) % 1000000 AS o FROM (
    SELECT 0 AS src, o, pattern, replacement FROM (VALUES {", ".join(
        f"({i}, {duck.sql_str(x.pattern)}, {duck.sql_str(x.replacement)})" for i, x in enumerate(P5_RULES))}) t(o, pattern, replacement)
    UNION ALL SELECT 1 AS src, o, '^' || replace(regexp_replace(replacement, {duck.sql_str(_ESC)}, '\\\\\\1', 'g'), '*', '.*') || '$' AS pattern,
                     replacement FROM ({_top_pattern_rules_sql()}))
  GROUP BY replacement)"""))
def k8_rule_file_roundtrip(spark, sf):
    # the stored rule document (as the reference writes it) ...
    doc_dir = shared_dir(spark, "rule-doc")
    doc = {"patternRules": [{"pattern": x.pattern, "replacement": x.replacement} for x in P5_RULES]}
    spark.createDataFrame([(json.dumps(doc),)], "value STRING").write.text(doc_dir)
    stored = W.read_rule_document(spark, doc_dir)
    # ... merged with rules of the current top patterns, saved and loaded again
    top = stats.uri_patterns(requests_relation(spark, sf), max_patterns=6)
    new = rules_from_patterns([row["pattern"] for row in top.collect()])
    new_df = spark.createDataFrame([(i, x.pattern, x.replacement) for i, x in enumerate(new)],
                                   "ord INT, pattern STRING, replacement STRING")
    path = W.save_rules(merge_rules(stored, new_df), shared_dir(spark, "rules"))
    return W.load_rules(spark, path).select("ord", "pattern", "replacement")


_HTTPD = PRESETS["httpd"]


@register("l9_streaming_window_counts", _sql("httpd", f"""
SELECT ts AS window_start, ts + INTERVAL 1 SECOND AS window_end, count(*) AS count FROM (
  SELECT time AS ts FROM ({duck_parse(_HTTPD.pattern, list(_HTTPD.columns), _HTTPD.types, 'HTTPD',
                                      out=['time'], httpd_time=True)}) WHERE time IS NOT NULL)
GROUP BY 1, 2"""))
def l9_streaming_window_counts(spark, sf):
    src = shared_dir(spark, "live-source")
    land_lines(spark, sf, "httpd").select("value").write.text(src)
    query, out = live_window_counts(spark, src, _HTTPD, window="1s", max_files_per_trigger=4)
    query.awaitTermination()
    return normalized(read_window_counts(spark, out))

