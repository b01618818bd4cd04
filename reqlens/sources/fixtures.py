"""The ``requests`` relation derived from the driver tables.

No HTTP log ships with the test data, so every query runs over a request table
derived from ``events ⋈ pages`` (one request per event).  The derivation is
written twice — once as a Spark plan, once as DuckDB SQL for the oracle — and
both must agree column for column.

Rules (all deterministic, so both engines produce the same rows):

* ``time = ts`` (null when ``event_id % 101 = 0``), ``request_creation_time = ts - 1 s``
* ``client_ip = 10.a.b.c`` from the three low bytes of ``user_id``
* ``request_url = pages.url`` with ``page_id = event_id % n_pages``
* ``status``: error events 500 (even id) / 404 (odd id); else 302 when
  ``event_id % 17 = 0``; else 200; null when ``event_id % 97 = 0``
* processing times (seconds): request ``value/100000``, target ``value/1000``,
  response ``value/50000``
* ``sent_bytes = k*37+100``, ``received_bytes = k*11+20`` with ``k`` from ``props``
* ``request_verb``: POST for purchase/signup, else GET
* ``target_ip = 10.1.0.(id%8)``, ``target_port = 8080 + id%3``; both null when
  ``event_id % 23 = 0``

The join to ``pages`` is an equi-join on a computed key; Spark picks the join
strategy from table statistics (``pages`` is a small dimension table, so it is
broadcast by the size-checked ``autoBroadcastJoinThreshold``, never by hint).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_COLUMNS = [
    "event_id", "time", "request_creation_time", "client_ip", "request_verb",
    "request_url", "status", "target_ip", "target_port", "sent_bytes",
    "received_bytes", "request_processing_time", "target_processing_time",
    "response_processing_time",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: rows of ``events`` and of ``documents`` that one task makes lines of
EVENTS_A_TASK, DOCUMENTS_A_TASK = 50_000, 2_000


def tasks_for(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(df.count() / rows))


def requests_relation(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``requests`` for the tables in ``sf_dir`` (see module docstring).

    ``spread`` deals the events over tasks of ``EVENTS_A_TASK`` rows: a row of some
    20 bytes in the file becomes 400 bytes of text, and the file may have few
    row groups, so its splits say little about the work."""
    events = table(spark, sf_dir, "events")
    if spread:
        events = events.repartition(tasks_for(events, EVENTS_A_TASK), "event_id", "ts", "user_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("request_url"))
    # cardinality of a dimension table: one scalar to the driver
    n_pages = pages.count()
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    unpaired = (eid % 23) == 0
    ev = events.select(
        eid,
        F.when(eid % 101 == 0, F.lit(None)).otherwise(F.col("ts")).alias("time"),
        (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("request_creation_time"),
        F.concat_ws(".", F.lit("10"),
                    F.expr("CAST((user_id div 65536) % 256 AS STRING)"),
                    F.expr("CAST((user_id div 256) % 256 AS STRING)"),
                    (F.col("user_id") % 256).cast("string")).alias("client_ip"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("POST"))
         .otherwise(F.lit("GET")).alias("request_verb"),
        F.when(eid % 97 == 0, F.lit(None).cast("int"))
         .when(F.col("event_type") == "error",
               F.when(eid % 2 == 0, F.lit(500)).otherwise(F.lit(404)))
         .when(eid % 17 == 0, F.lit(302))
         .otherwise(F.lit(200)).alias("status"),
        F.when(unpaired, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("10.1.0."), (eid % 8).cast("string"))).alias("target_ip"),
        F.when(unpaired, F.lit(None).cast("bigint"))
         .otherwise(F.lit(8080) + eid % 3).alias("target_port"),
        (k * 37 + 100).alias("sent_bytes"),
        (k * 11 + 20).alias("received_bytes"),
        (F.col("value") / 100000).alias("request_processing_time"),
        (F.col("value") / 1000).alias("target_processing_time"),
        (F.col("value") / 50000).alias("response_processing_time"),
        (eid % F.lit(n_pages)).alias("page_id"),
    )
    return ev.join(pages, "page_id").select(*REQUEST_COLUMNS)


# DuckDB text of the same relation; oracle queries start with ``WITH requests AS (...)``.
REQUESTS_SQL = """
SELECT e.event_id,
       CASE WHEN e.event_id % 101 = 0 THEN NULL ELSE e.ts END AS time,
       e.ts - INTERVAL 1 SECOND AS request_creation_time,
       '10.' || CAST((e.user_id // 65536) % 256 AS VARCHAR) || '.' ||
       CAST((e.user_id // 256) % 256 AS VARCHAR) || '.' || CAST(e.user_id % 256 AS VARCHAR) AS client_ip,
       CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS request_verb,
       p.url AS request_url,
       CASE WHEN e.event_id % 97 = 0 THEN NULL
            WHEN e.event_type = 'error' THEN CASE WHEN e.event_id % 2 = 0 THEN 500 ELSE 404 END
            WHEN e.event_id % 17 = 0 THEN 302 ELSE 200 END::INTEGER AS status,
       CASE WHEN e.event_id % 23 = 0 THEN NULL ELSE '10.1.0.' || CAST(e.event_id % 8 AS VARCHAR) END AS target_ip,
       CASE WHEN e.event_id % 23 = 0 THEN NULL ELSE 8080 + e.event_id % 3 END::BIGINT AS target_port,
       CAST(json_extract_string(e.props, '$.k') AS BIGINT) * 37 + 100 AS sent_bytes,
       CAST(json_extract_string(e.props, '$.k') AS BIGINT) * 11 + 20 AS received_bytes,
       e.value / 100000 AS request_processing_time,
       e.value / 1000 AS target_processing_time,
       e.value / 50000 AS response_processing_time
FROM events e
JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
"""


def with_requests(body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the ``requests`` CTE (and optional more CTEs)."""
    more = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH requests AS ({REQUESTS_SQL}){more}\n{body}"


# ---------------------------------------------------------------------------
# Rendered log lines: ``requests`` written out as text in several formats,
# plus junk lines (every line of every document).  Spark renders them here;
# ``LINES_SQL`` renders the very same text in DuckDB for the oracles.
# ---------------------------------------------------------------------------
LINE_FORMATS = ("alb", "httpd", "nginx", "httpd_with_time", "httpd_custom", "grok", "json")


def _q(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def _dash(c):
    return F.coalesce(c.cast("string"), F.lit("-"))


def _f(c, spec: str):
    return F.format_string(spec, c)


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _clf_time(c, eid):
    east = F.concat(F.date_format(c + F.expr("INTERVAL 9 HOURS"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0900"))
    utc = F.concat(F.date_format(c, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    return _dash(F.when(eid % 4 == 1, east).otherwise(utc))


def render_lines(req: DataFrame, fmt: str, *keep: Column) -> DataFrame:
    """``(value)`` lines of ``fmt`` for every request row."""
    eid = F.col("event_id")
    s = lambda x: x.cast("string")
    target = _dash(F.concat(F.col("target_ip"), F.lit(":"), s(F.col("target_port"))))
    request = F.concat_ws(" ", F.col("request_verb"), F.col("request_url"), F.lit("HTTP/1.1"))
    agent = F.concat(F.lit("agent/1.0 (n"), s(eid % 7), F.lit(")"))
    referer = F.concat(F.lit("https://ref.example.com/"), s(eid % 5))
    user = F.when(eid % 7 == 0, F.concat(F.lit("u"), s(eid % 13))).otherwise(F.lit("-"))
    if fmt == "alb":
        head = F.concat_ws(
            " ", F.when(eid % 2 == 0, F.lit("https")).otherwise(F.lit("http")), _dash(_iso(F.col("time"))),
            F.lit("app/main-lb/50dc6c495c0c9188"),
            F.concat(F.col("client_ip"), F.lit(":"), s(F.lit(40000) + eid % 1000)), target,
            _f(F.col("request_processing_time"), "%.9f"), _f(F.col("target_processing_time"), "%.9f"),
            _f(F.col("response_processing_time"), "%.9f"), _dash(F.col("status")), _dash(F.col("status")),
            s(F.col("received_bytes")), s(F.col("sent_bytes")), _q(request), _q(agent),
            F.lit("ECDHE-RSA-AES128-GCM-SHA256"), F.lit("TLSv1.2"))
        tail = F.concat_ws(
            " ", F.lit("tg-main"), _q(F.concat(F.lit("Root=1-"), s(eid))), _q(F.lit("example.com")),
            _q(F.lit("-")), s(eid % 50), _dash(_iso(F.col("request_creation_time"))), _q(F.lit("forward")),
            _q(F.lit("-")), _q(F.lit("-")), _q(target), _q(_dash(F.col("status"))), _q(F.lit("-")),
            _q(F.lit("-")), F.concat(F.lit("TID_"), s(eid)))
        line = F.when(eid % 5 == 0, head).otherwise(F.concat_ws(" ", head, tail))
    elif fmt == "grok":
        level = (F.when(F.col("status") >= 500, F.lit("ERROR")).when(F.col("status") >= 400, F.lit("WARN"))
                 .otherwise(F.lit("INFO")))
        line = F.concat_ws(" ", _dash(F.date_format(F.col("time"), "yyyy-MM-dd HH:mm:ss")),
                           F.concat(F.lit("["), level, F.lit("]")), request, _dash(F.col("status")))
    elif fmt in ("httpd", "nginx", "httpd_with_time", "httpd_custom"):
        req_text = F.when(eid % 29 == 0, F.lit("-")).otherwise(request) if fmt == "httpd" else request
        nbytes = F.when(eid % 11 == 0, F.lit("-")).otherwise(s(F.col("sent_bytes")))
        base = F.concat_ws(" ", F.col("client_ip"), F.lit("-"), user,
                           F.concat(F.lit("["), _clf_time(F.col("time"), eid), F.lit("]")),
                           _q(req_text), _dash(F.col("status")), nbytes)
        quoted = F.concat_ws(" ", base, _q(referer), _q(agent))
        us = F.round(F.col("target_processing_time") * 1000000).cast("bigint")
        if fmt == "httpd":
            line = F.when(eid % 3 == 0, base).otherwise(quoted)
        elif fmt == "httpd_custom":
            line = F.concat_ws(" ", base, s(us))
        elif fmt == "nginx":
            line = F.concat_ws(" ", quoted, _f(F.col("target_processing_time"), "%.6f"))
        else:
            line = F.concat_ws(" ", quoted, s(us))
    elif fmt == "json":
        line = F.to_json(F.struct(
            _iso(F.col("time")).alias("timestamp"), F.col("request_verb").alias("method"),
            F.col("request_url").alias("url"), F.col("status").alias("status"),
            (F.col("target_processing_time") * 1000).alias("response_time"),
            F.col("client_ip").alias("client_ip"), F.col("sent_bytes").alias("bytes_sent")),
            {"ignoreNullFields": "false"})
    else:
        raise ValueError(f"unknown line format {fmt!r}")
    return req.select(*keep, line.alias("value"))


def junk_lines(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    """Every line of every document, as non-log noise.  Lines end as Spark's
    text reader ends them: at LF, CR or CR LF."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text").repartition(tasks_for(docs, DOCUMENTS_A_TASK), "doc_id")
    return docs.select(*keep, F.explode(F.split("text", "\r\n|\r|\n")).alias("value"))


def log_lines(spark: SparkSession, sf_dir: str, fmt: str, junk: bool = True) -> DataFrame:
    lines = render_lines(requests_relation(spark, sf_dir, spread=True), fmt)
    return lines.unionByName(junk_lines(spark, sf_dir)) if junk else lines


def _d_dash(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '-')"


def _d_iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _d_clf_time(x: str) -> str:
    return (f"coalesce(CASE WHEN event_id % 4 = 1 THEN strftime({x} + INTERVAL 9 HOUR, '%d/%b/%Y:%H:%M:%S') "
            f"|| ' +0900' ELSE strftime({x}, '%d/%b/%Y:%H:%M:%S') || ' +0000' END, '-')")


_D_TARGET = _d_dash("target_ip || ':' || CAST(target_port AS VARCHAR)")
_D_REQUEST = "request_verb || ' ' || request_url || ' HTTP/1.1'"
_D_AGENT = "'agent/1.0 (n' || CAST(event_id % 7 AS VARCHAR) || ')'"
_D_REFERER = "'https://ref.example.com/' || CAST(event_id % 5 AS VARCHAR)"
_D_USER = "CASE WHEN event_id % 7 = 0 THEN 'u' || CAST(event_id % 13 AS VARCHAR) ELSE '-' END"


def _d_clf_base(request_sql: str) -> str:
    nbytes = "CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(sent_bytes AS VARCHAR) END"
    return (f"client_ip || ' - ' || {_D_USER} || ' [' || {_d_clf_time('time')} || '] \"' || {request_sql} || '\" ' "
            f"|| {_d_dash('status')} || ' ' || {nbytes}")


def _d_quoted(base: str) -> str:
    return f"{base} || ' \"' || {_D_REFERER} || '\" \"' || {_D_AGENT} || '\"'"


_D_ALB_HEAD = (
    "CASE WHEN event_id % 2 = 0 THEN 'https' ELSE 'http' END || ' ' || " + _d_dash(_d_iso("time"))
    + " || ' app/main-lb/50dc6c495c0c9188 ' || client_ip || ':' || CAST(40000 + event_id % 1000 AS VARCHAR) || ' ' || "
    + _D_TARGET + " || ' ' || printf('%.9f', request_processing_time) || ' ' || printf('%.9f', target_processing_time)"
    " || ' ' || printf('%.9f', response_processing_time) || ' ' || " + _d_dash("status") + " || ' ' || "
    + _d_dash("status") + " || ' ' || CAST(received_bytes AS VARCHAR) || ' ' || CAST(sent_bytes AS VARCHAR) || ' \"' || "
    + _D_REQUEST + " || '\" \"' || " + _D_AGENT + " || '\" ECDHE-RSA-AES128-GCM-SHA256 TLSv1.2'")
_D_ALB_TAIL = (
    "'tg-main \"Root=1-' || CAST(event_id AS VARCHAR) || '\" \"example.com\" \"-\" ' || CAST(event_id % 50 AS VARCHAR)"
    " || ' ' || " + _d_dash(_d_iso("request_creation_time")) + " || ' \"forward\" \"-\" \"-\" \"' || " + _D_TARGET
    + " || '\" \"' || " + _d_dash("status") + " || '\" \"-\" \"-\" TID_' || CAST(event_id AS VARCHAR)")

LINE_SQL = {
    "alb": f"CASE WHEN event_id % 5 = 0 THEN {_D_ALB_HEAD} ELSE {_D_ALB_HEAD} || ' ' || {_D_ALB_TAIL} END",
    "httpd": (f"CASE WHEN event_id % 3 = 0 THEN {_d_clf_base(f'CASE WHEN event_id % 29 = 0 THEN {chr(39)}-{chr(39)} ELSE {_D_REQUEST} END')}"
              f" ELSE {_d_quoted(_d_clf_base(f'CASE WHEN event_id % 29 = 0 THEN {chr(39)}-{chr(39)} ELSE {_D_REQUEST} END'))} END"),
    "nginx": f"{_d_quoted(_d_clf_base(_D_REQUEST))} || ' ' || printf('%.6f', target_processing_time)",
    "httpd_with_time": (f"{_d_quoted(_d_clf_base(_D_REQUEST))} || ' ' || "
                        "CAST(CAST(round(target_processing_time * 1000000) AS BIGINT) AS VARCHAR)"),
    "httpd_custom": (f"{_d_clf_base(_D_REQUEST)} || ' ' || "
                     "CAST(CAST(round(target_processing_time * 1000000) AS BIGINT) AS VARCHAR)"),
    "grok": ("coalesce(strftime(time, '%Y-%m-%d %H:%M:%S'), '-') || ' [' || CASE WHEN status >= 500 THEN 'ERROR' "
             "WHEN status >= 400 THEN 'WARN' ELSE 'INFO' END || '] ' || " + _D_REQUEST + " || ' ' || "
             + _d_dash("status")),
}
JUNK_SQL = r"SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS value FROM documents"


def lines_cte(fmt: str, junk: bool = True) -> str:
    """DuckDB CTE ``lines(value)`` for ``fmt`` (requires the ``requests`` CTE)."""
    if fmt == "json":
        body = ("SELECT json_object('timestamp', " + _d_iso("time") + ", 'method', request_verb, 'url', request_url,"
                " 'status', status, 'response_time', target_processing_time * 1000, 'client_ip', client_ip,"
                " 'bytes_sent', sent_bytes)::VARCHAR AS value FROM requests")
    else:
        body = f"SELECT {LINE_SQL[fmt]} AS value FROM requests"
    if junk:
        body = f"{body} UNION ALL {JUNK_SQL}"
    return f"lines AS ({body})"


# ---------------------------------------------------------------------------
# A larger request table for benches: one request per ``lineitem`` row, spread
# over all pages (or over the first ``urls`` of them: the published timing that
# the bench is set beside is for 1,000,000 requests over ~500 URLs).
# ---------------------------------------------------------------------------
def lineitem_requests(spark: SparkSession, sf_dir: str, urls: int | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("request_url"))
    n = urls or pages.count()
    ok = F.col("l_orderkey")
    rf = F.col("l_returnflag")
    rows = li.select(
        (ok * 8 + F.col("l_linenumber")).alias("event_id"),
        F.timestamp_add("SECOND", ok % 86400, F.col("l_shipdate")).alias("time"),
        F.concat_ws(".", F.lit("10"), F.lit("2"), F.expr("CAST((l_suppkey div 256) % 256 AS STRING)"),
                    (F.col("l_suppkey") % 256).cast("string")).alias("client_ip"),
        F.when(rf == "R", F.when(F.col("l_linenumber") % 2 == 0, F.lit(500)).otherwise(F.lit(404)))
         .when(ok % 17 == 0, F.lit(302)).otherwise(F.lit(200)).alias("status"),
        (F.col("l_extendedprice") / 100000).alias("target_processing_time"),
        (F.col("l_discount") / 10).alias("request_processing_time"),
        (F.col("l_tax") / 10).alias("response_processing_time"),
        (F.col("l_quantity") * 100).cast("bigint").alias("sent_bytes"),
        (F.col("l_partkey") % F.lit(n)).alias("page_id"))
    return rows.join(pages, "page_id").drop("page_id")


LINEITEM_REQUESTS_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS event_id,
       l_shipdate + to_seconds(l_orderkey % 86400) AS time,
       '10.2.' || CAST((l_suppkey // 256) % 256 AS VARCHAR) || '.' || CAST(l_suppkey % 256 AS VARCHAR) AS client_ip,
       CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 500 ELSE 404 END
            WHEN l_orderkey % 17 = 0 THEN 302 ELSE 200 END::INTEGER AS status,
       l_extendedprice / 100000 AS target_processing_time, l_discount / 10 AS request_processing_time,
       l_tax / 10 AS response_processing_time, CAST(l_quantity * 100 AS BIGINT) AS sent_bytes,
       p.url AS request_url
FROM lineitem JOIN pages p ON p.page_id = l_partkey % (SELECT count(*) FROM pages)
"""
