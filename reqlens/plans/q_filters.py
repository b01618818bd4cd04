"""Filter queries (F1–F11) over the derived ``requests`` relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import filters as FL
from reqlens.operators import stats
from reqlens.plans import duck
from reqlens.plans.registry import register
from reqlens.sources.fixtures import requests_relation, with_requests, table

# Fixed test parameters for the filter queries.
F1_START, F1_END = "2024-01-03T00:00:00", "2024-01-05T21:00:00+09:00"
F4_SPECS = "10.0.0.64/27, 10.0.0.7, 10.0.0.300/24, 2001:db8::/32"
F6_PATTERNS = ["https://blog.*", "http://www.*/en/"]
F7_GLOBS = ["*/en/*.html", "https://m.*", "*[0-9]?page=2*"]
F10_EXCLUDE, F10_INCLUDE = "spam,PILLS", "blog,/EN/"


def _ipnum(c: str) -> str:
    return (f"(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536"
            f" + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))")


@register("f1_time_range", with_requests("""
SELECT event_id, time FROM requests
WHERE time >= TIMESTAMP '2024-01-03 00:00:00' AND time <= TIMESTAMP '2024-01-05 12:00:00'"""))
def f1_time_range(spark, sf):
    req = requests_relation(spark, sf)
    return FL.filter_time(req, F1_START, F1_END).select("event_id", "time")


@register("f2_status_filter", with_requests("""
SELECT event_id, status FROM requests WHERE (status >= 400 AND status < 500) OR status = 302"""))
def f2_status_filter(spark, sf):
    return FL.filter_status(requests_relation(spark, sf), "4xx,302").select("event_id", "status")


@register("f3_response_time_filter", with_requests("""
SELECT event_id, target_processing_time FROM requests
WHERE target_processing_time >= 0.005 AND target_processing_time <= 0.2
  AND request_processing_time >= 0.00002"""))
def f3_response_time_filter(spark, sf):
    req = FL.filter_response_time(requests_relation(spark, sf), min="5ms", max="0.2s")
    req = FL.filter_response_time(req, min_ms=0.02, rt="request_processing_time", unit="s")
    return req.select("event_id", "target_processing_time")


@register("f4_client_cidr", with_requests(f"""
SELECT event_id, client_ip FROM requests
WHERE ({_ipnum('client_ip')} & 4294967264) = {10 * 16777216 + 64} OR client_ip = '10.0.0.7'"""))
def f4_client_cidr(spark, sf):
    return FL.filter_client(requests_relation(spark, sf), F4_SPECS).select("event_id", "client_ip")


# 2,000 IPv4 blocks (every third /26), 25 IPv6 /48 and one /47, single addresses
LONG_LIST = ([f"10.{n >> 10 & 255}.{n >> 2 & 255}.{(n & 3) << 6}/26" for n in range(0, 6000, 3)]
             + [f"2001:db8:{i:x}::/48" for i in range(25)] + ["2001:db8:31::1/47", "10.0.0.1", "10.0.0.0/99", "nonsense/8"])


def _clients(spark, sf):
    """Requests, every second one from an IPv6 client."""
    user = table(spark, sf, "events").select("event_id", "user_id")
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("user_id") % 50)), F.lit("::"), F.lower(F.hex(F.col("user_id") % 65536)))
    return (requests_relation(spark, sf).join(user, "event_id")
            .select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("client_ip")).otherwise(v6).alias("client_ip")))


@register("f4b_client_networks", with_requests("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN client_ip
                      ELSE '2001:db8:' || printf('%x', user_id % 50) || '::' || printf('%x', user_id % 65536) END AS client_ip
FROM requests JOIN (SELECT event_id, user_id FROM events) USING (event_id)
WHERE CASE WHEN event_id % 2 = 0 THEN ((user_id % 16777216) // 64 < 6000 AND (user_id % 16777216) // 64 % 3 = 0) OR client_ip = '10.0.0.1'
           ELSE user_id % 50 < 25 OR user_id % 50 IN (48, 49) END"""))
def f4b_client_networks(spark, sf):
    return FL.filter_client(_clients(spark, sf), LONG_LIST)


@register("f5_url_list", with_requests("""
SELECT event_id, request_url FROM requests WHERE request_url IN (
  SELECT request_url FROM requests GROUP BY 1 ORDER BY count(*) DESC, request_url LIMIT 10)"""))
def f5_url_list(spark, sf):
    req = requests_relation(spark, sf)
    top = stats.url_counts(req, include_params=True).orderBy(F.desc("count"), "url").limit(10).select("url")
    return FL.filter_urls(req, top).select("event_id", "request_url")


@register("f6_uri_prefix", with_requests(f"""
SELECT event_id, request_url FROM requests
WHERE regexp_matches(request_url, {duck.sql_str(FL.uri_pattern_regex(F6_PATTERNS))})"""))
def f6_uri_prefix(spark, sf):
    return FL.filter_uri_patterns(requests_relation(spark, sf), F6_PATTERNS).select("event_id", "request_url")


@register("f7_glob", with_requests(
    "SELECT event_id, request_url FROM requests WHERE "
    + " OR ".join(f"request_url GLOB {duck.sql_str(g)}" for g in F7_GLOBS)))
def f7_glob(spark, sf):
    return FL.filter_glob(requests_relation(spark, sf), F7_GLOBS).select("event_id", "request_url")


@register("f8_threshold", with_requests(
    "SELECT event_id, sent_bytes FROM requests WHERE sent_bytes > 3000"))
def f8_threshold(spark, sf):
    return FL.apply_row_filter(requests_relation(spark, sf), "request_url", "threshold:sent_bytes:>:3000") \
        .select("event_id", "sent_bytes")


@register("f9_top_groups", with_requests("""
SELECT event_id, request_url FROM requests WHERE request_url IN (
  SELECT request_url FROM requests WHERE request_url IS NOT NULL GROUP BY 1
  ORDER BY sum(sent_bytes) DESC NULLS LAST, request_url LIMIT 5)"""))
def f9_top_groups(spark, sf):
    return FL.apply_row_filter(requests_relation(spark, sf), "request_url", "top:5:sum:sent_bytes") \
        .select("event_id", "request_url")


_PATTERNS_SQL = f"""
SELECT {duck.generalize_url('url')} AS pattern, CAST(sum(n) AS BIGINT) AS count
FROM (SELECT split_part(request_url, '?', 1) AS url, count(*) AS n FROM requests GROUP BY 1)
GROUP BY 1"""


@register("f10_pattern_include_exclude", with_requests(f"""
SELECT pattern, count FROM ({_PATTERNS_SQL})
WHERE NOT (contains(lower(pattern), 'spam') OR contains(lower(pattern), 'pills'))
  AND (contains(lower(pattern), 'blog') OR contains(lower(pattern), '/en/'))"""))
def f10_pattern_include_exclude(spark, sf):
    pats = stats.uri_patterns(requests_relation(spark, sf))
    return FL.filter_pattern_table(pats, include=F10_INCLUDE, exclude=F10_EXCLUDE)


@register("f10b_pattern_regex", with_requests(f"""
SELECT pattern, count FROM ({_PATTERNS_SQL})
WHERE NOT regexp_matches(pattern, '^https') AND regexp_matches(pattern, 'example[.](org|net)')"""))
def f10b_pattern_regex(spark, sf):
    pats = stats.uri_patterns(requests_relation(spark, sf))
    return FL.filter_pattern_table(pats, include=[r"example[.](org|net)"], exclude=["^https"],
                                   case_sensitive=True, use_regex=True)


@register("f11_drop_incomplete", with_requests("""
SELECT event_id FROM requests WHERE time IS NOT NULL AND status IS NOT NULL"""))
def f11_drop_incomplete(spark, sf):
    return FL.drop_incomplete(requests_relation(spark, sf), ["time", "status"]).select("event_id")
