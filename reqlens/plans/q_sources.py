"""Source queries (S1–S25, L7, L8, P16) over rendered log text.

Spark side: the rendered lines are landed as gzip text files under the shared
checkpoint folder and read back with ``read_lines`` (S1/S2), then parsed.
Oracle side: DuckDB renders the same text and parses it with its own regex
engine (``regexp_extract`` with group names, ``try_strptime``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.session import shared_dir
from reqlens.sources import fixtures as FX
from reqlens.sources import text as TX
from reqlens.sources.formats import PRESETS, LogFormat, compile_apache_format, custom_format
from reqlens.plans import duck
from reqlens.plans.registry import normalized, r, register

WS = TX.WS_CLASS
CUSTOM_REGEX = r'(?P<client_ip>[^ ]+) \S+ (?P<user>\S+) \[(?P<time>[^\]]+)\] "(?P<method>[A-Z]+) (?P<url>[^ ]+)'
# hand-written expectation of the compiled 'combined' LogFormat (independent of the compiler)
COMBINED_REGEX = r'([^ ]+) ([^ ]+) ([^ ]+) \[([^\]]+)\] "([^"]*)" ([-0-9]+) ([-0-9]+) "([^"]*)" "([^"]*)"'
COMBINED_COLUMNS = ["client_ip", "identity", "user", "time", "request", "status", "bytes_sent", "referer",
                    "user_agent"]


_LANDED: dict[tuple, str] = {}


def _write_gzip(lines, path: str) -> None:
    # read once or twice and dropped: the fastest level
    lines.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def land_lines(spark, sf: str, fmt: str, junk: bool = True):
    """Write the rendered lines as gzip text into the shared folder (once per
    application and input); read them back."""
    def landed(name: str, make, *more) -> str:
        key = (spark.sparkContext.applicationId, sf, name, *more)
        if key not in _LANDED:
            path = shared_dir(spark, f"lines-{name}")
            _write_gzip(make(), path)
            _LANDED[key] = path
        return _LANDED[key]
    paths = [landed(fmt, lambda: FX.log_lines(spark, sf, fmt, junk=False), junk)]
    # the junk is the same in every line set: rendered and landed once for all of them
    return TX.read_lines(spark, [*paths, landed("junk", lambda: FX.junk_lines(spark, sf))] if junk else paths)


def _stripped_lines_cte(fmt: str) -> str:
    cte = FX.lines_cte(fmt)
    return (cte.replace("lines AS (", "raw_lines AS (", 1)
            + f",\nlines AS (SELECT v AS value FROM (SELECT regexp_replace(value, '^{WS}+|{WS}+$', '', 'g') AS v "
            "FROM raw_lines) WHERE v <> '')")


def _sql(fmt_lines: str, body: str) -> str:
    return FX.with_requests(body, _stripped_lines_cte(fmt_lines))


def _d_null(x: str) -> str:
    return f"(CASE WHEN {x} IN ('', '-', ' ') THEN NULL ELSE {x} END)"


def _d_typed(x: str, typ: str | None, httpd_time: bool, naive_time: bool = False) -> str:
    if typ == "int":
        return f"TRY_CAST({x} AS BIGINT)"
    if typ == "float":
        return f"TRY_CAST({x} AS DOUBLE)"
    if typ == "datetime":
        if httpd_time:
            return f"timezone('UTC', try_strptime({x}, '%d/%b/%Y:%H:%M:%S %z'))"
        if naive_time:
            return f"try_strptime({x}, '%Y-%m-%d %H:%M:%S')"
        return f"timezone('UTC', TRY_CAST({x} AS TIMESTAMPTZ))"
    return x


def _d_request_split(req: str) -> list[str]:
    s = f"regexp_replace({req}, '^{WS}+|{WS}+$', '', 'g')"
    n = f"least(length({s}) - length(replace({s}, ' ', '')) + 1, 3)"
    return [f"CASE WHEN {req} IS NOT NULL AND {n} >= 2 THEN split_part({s}, ' ', 1) END AS request_method",
            f"CASE WHEN {req} IS NOT NULL AND {n} >= 2 THEN split_part({s}, ' ', 2) "
            f"WHEN {req} IS NOT NULL THEN {s} END AS request_url",
            f"CASE WHEN {req} IS NOT NULL AND {n} = 3 THEN regexp_extract({s}, '^[^ ]* [^ ]* (.*)$', 1) END "
            "AS request_proto"]


def duck_parse(pattern: str, columns: list[str], types: dict, ptype: str, out: list[str] | None = None,
               httpd_time: bool = False, split_request: bool = False, rejected: bool = False,
               naive_time: bool = False) -> str:
    """DuckDB statement of the regex parse (body over ``lines``)."""
    anch = duck.sql_str(f"^(?:{pattern})")
    names = "[" + ", ".join(duck.sql_str(c) for c in columns) + "]"
    raw = {c: _d_null(f"g['{c}']") for c in columns}
    if ptype == "ALB":
        valid = f"coalesce({raw['time']}, {raw['request_url']}, {raw['request_verb']}) IS NOT NULL"
    elif ptype == "HTTPD":
        chk = [raw[c] for c in ("time", "timestamp", "status", "status_code") if c in raw]
        valid = f"coalesce({', '.join(chk)}) IS NOT NULL"
    else:
        valid = "TRUE"
    src = (f"(SELECT value, regexp_matches(value, {anch}) AND NOT contains(value, chr(1)) AS m, "
           f"regexp_extract(value, {anch}, {names}) AS g FROM lines)")
    if rejected:
        return f"SELECT count(*) AS n_rejected FROM {src} WHERE NOT (m AND {valid})"
    sel = [f"{_d_typed(raw[c], types.get(c), httpd_time, naive_time)} AS \"{c}\"" for c in (out or columns)]
    if split_request:
        sel += _d_request_split(raw["request"])
    return f"SELECT {', '.join(sel)} FROM {src} WHERE m AND {valid}"


def _norm(df):
    return normalized(df.drop("file"))


# ---------------------------------------------------------------------------
@register("s1_s2_read_lines", FX.with_requests(
    " UNION ALL ".join(
        f"SELECT '{f}' AS line_set, count(*) AS n_lines FROM (SELECT regexp_replace(value, '^{WS}+|{WS}+$', '', 'g') "
        f"AS v FROM lines_{f}) WHERE v <> ''" for f in FX.LINE_FORMATS),
    ",\n".join(FX.lines_cte(f).replace("lines AS (", f"lines_{f} AS (", 1) for f in FX.LINE_FORMATS)))
def s1_s2_read_lines(spark, sf):
    base = shared_dir(spark, "lines-all")
    for f in FX.LINE_FORMATS:
        _write_gzip(FX.log_lines(spark, sf, f), f"{base}/{f}")
    lines = TX.read_lines(spark, f"{base}/*/part-*")
    return (lines.groupBy(F.regexp_extract("file", r"/([a-z_]+)/part-[^/]*$", 1).alias("line_set"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


_ALB = PRESETS["alb"]


@register("s3_s6_alb_parse", _sql("alb", duck_parse(_ALB.pattern, list(_ALB.columns), _ALB.types, "ALB")))
def s3_s6_alb_parse(spark, sf):
    return _norm(TX.parse_lines(land_lines(spark, sf, "alb"), _ALB).records)


@register("s18_alb_rejected", _sql("alb", duck_parse(_ALB.pattern, list(_ALB.columns), _ALB.types, "ALB",
                                                     rejected=True)))
def s18_alb_rejected(spark, sf):
    res = TX.parse_lines(land_lines(spark, sf, "alb"), _ALB)
    return res.rejected.agg(F.count(F.lit(1)).alias("n_rejected"))


@register("s17_alb_pruned", _sql("alb", duck_parse(_ALB.pattern, list(_ALB.columns), _ALB.types, "ALB",
                                                   out=["time", "request_url", "target_processing_time"])))
def s17_alb_pruned(spark, sf):
    res = TX.parse_lines(land_lines(spark, sf, "alb"), _ALB,
                         columns=["time", "request_url", "target_processing_time"])
    return _norm(res.records)


_HTTPD = PRESETS["httpd"]


@register("s7_s12_httpd_parse", _sql("httpd", duck_parse(_HTTPD.pattern, list(_HTTPD.columns), _HTTPD.types,
                                                         "HTTPD", httpd_time=True, split_request=True)))
def s7_s12_httpd_parse(spark, sf):
    return _norm(TX.parse_lines(land_lines(spark, sf, "httpd"), _HTTPD).records)


@register("s18b_httpd_rejected", _sql("httpd", duck_parse(_HTTPD.pattern, list(_HTTPD.columns), _HTTPD.types,
                                                          "HTTPD", rejected=True)))
def s18b_httpd_rejected(spark, sf):
    res = TX.parse_lines(land_lines(spark, sf, "httpd"), _HTTPD)
    return res.rejected.agg(F.count(F.lit(1)).alias("n_rejected"))


_HWT = PRESETS["httpd_with_time"]


@register("s8_httpd_with_time_parse", _sql("httpd_with_time", duck_parse(
    _HWT.pattern, list(_HWT.columns), _HWT.types, "HTTPD", httpd_time=True)))
def s8_httpd_with_time_parse(spark, sf):
    return _norm(TX.parse_lines(land_lines(spark, sf, "httpd_with_time"), _HWT).records)


_NGX = PRESETS["nginx"]
_HCU = PRESETS["httpd_custom"]
_GROK = PRESETS["grok"]


@register("s8b_httpd_custom_parse", _sql("httpd_custom", duck_parse(
    _HCU.pattern, list(_HCU.columns), _HCU.types, "HTTPD", httpd_time=True, split_request=True)))
def s8b_httpd_custom_parse(spark, sf):
    return _norm(TX.parse_lines(land_lines(spark, sf, "httpd_custom"), _HCU).records)


@register("s10b_grok_parse", _sql("grok", duck_parse(_GROK.pattern, list(_GROK.columns), _GROK.types, "GROK",
                                                     naive_time=True)))
def s10b_grok_parse(spark, sf):
    return _norm(TX.parse_lines(land_lines(spark, sf, "grok"), _GROK).records)


@register("s9_nginx_parse", _sql("nginx", duck_parse(_NGX.pattern, list(_NGX.columns), _NGX.types, "HTTPD",
                                                     httpd_time=True)))
def s9_nginx_parse(spark, sf):
    return _norm(TX.parse_lines(land_lines(spark, sf, "nginx"), _NGX).records)


@register("s10_s4_custom_named_regex", _sql("httpd", f"""
SELECT {', '.join(f"{_d_null(f'g[{chr(39)}{c}{chr(39)}]')} AS {c}" for c in ['client_ip', 'user', 'time', 'method', 'url'])}
FROM (SELECT regexp_extract(value, {duck.sql_str('^(?:' + CUSTOM_REGEX + ')')},
      ['client_ip', 'user', 'time', 'method', 'url']) AS g FROM lines
      WHERE regexp_matches(value, {duck.sql_str('^(?:' + CUSTOM_REGEX + ')')}) AND NOT contains(value, chr(1)))"""))
def s10_s4_custom_named_regex(spark, sf):
    fmt = custom_format(CUSTOM_REGEX)
    return _norm(TX.parse_lines(land_lines(spark, sf, "httpd"), fmt).records)


@register("s11_apache_logformat", _sql("httpd", duck_parse(
    COMBINED_REGEX, COMBINED_COLUMNS, {"time": "datetime", "status": "int", "bytes_sent": "int"}, "HTTPD",
    httpd_time=True, split_request=True)))
def s11_apache_logformat(spark, sf):
    fmt = compile_apache_format("combined")
    return _norm(TX.parse_lines(land_lines(spark, sf, "httpd"), fmt).records)


_ALB_NOCOLS = LogFormat("alb-nocols", _ALB.pattern, (), {}, "ALB")


@register("s15_alb_fallback", _sql("alb", f"""
SELECT {', '.join(f"{_d_null(f'g[{chr(39)}{c}{chr(39)}]')} AS {c}" for c in _ALB.columns[:17])},
       17 AS n_extra_groups
FROM (SELECT regexp_extract(value, {duck.sql_str('^(?:' + _ALB.pattern + ')')},
      [{', '.join(duck.sql_str(c) for c in _ALB.columns)}]) AS g FROM lines
      WHERE regexp_matches(value, {duck.sql_str('^(?:' + _ALB.pattern + ')')}) AND NOT contains(value, chr(1)))"""))
def s15_alb_fallback(spark, sf):
    rec = TX.parse_lines(land_lines(spark, sf, "alb"), _ALB_NOCOLS).records
    return rec.drop("file").withColumn("n_extra_groups", F.size("_extra_groups")).drop("_extra_groups")


@register("s5_json_parse", _sql("json", f"""
SELECT timezone('UTC', TRY_CAST(json_extract_string(value, '$.timestamp') AS TIMESTAMPTZ)) AS "timestamp",
       json_extract_string(value, '$.method') AS method, json_extract_string(value, '$.url') AS url,
       TRY_CAST(json_extract(value, '$.status') AS BIGINT) AS status,
       {r("TRY_CAST(json_extract(value, '$.response_time') AS DOUBLE)", 'response_time')},
       json_extract_string(value, '$.client_ip') AS client_ip,
       TRY_CAST(json_extract(value, '$.bytes_sent') AS BIGINT) AS bytes_sent
FROM lines WHERE starts_with(value, '{{') AND json_valid(value)"""))
def s5_json_parse(spark, sf):
    return _norm(TX.parse_json_lines(land_lines(spark, sf, "json")).records)


@register("l8_json_defaults", _sql("json", """
SELECT json_extract_string(value, '$.timestamp') AS time, json_extract_string(value, '$.url') AS url,
       coalesce(json_extract_string(value, '$.method'), 'GET') AS method,
       coalesce(CAST(TRY_CAST(json_extract(value, '$.status') AS BIGINT) AS VARCHAR), '200') AS status,
       CAST(coalesce(nullif(TRY_CAST(json_extract(value, '$.bytes_sent') AS DOUBLE), 0), 0) AS DOUBLE) AS bytes,
       coalesce(json_extract_string(value, '$.client_ip'), 'unknown') AS client_ip,
       CAST(0 AS DOUBLE) AS response_time
FROM lines WHERE starts_with(value, '{') AND json_valid(value)"""))
def l8_json_defaults(spark, sf):
    return normalized(TX.json_defaults(land_lines(spark, sf, "json")))


def _detect_sql(f: str) -> str:
    alb = ("(" + " OR ".join(f"starts_with(value, '{p}')" for p in TX.ALB_PREFIXES) + ") AND "
           f"len(string_split_regex(regexp_replace(value, '^{WS}+|{WS}+$', '', 'g'), '\\s+')) > 10 "
           "AND contains(value, 'app/')")
    js = "(starts_with(value, '{') OR starts_with(value, '[')) AND json_valid(value)"
    ap = f"contains(value, '\"') AND contains(value, '[') AND regexp_matches(value, {duck.sql_str(TX.APACHE_HINT)})"
    return (f"SELECT '{f}' AS line_set, count(*) FILTER (WHERE {alb}) AS alb, count(*) FILTER (WHERE {js}) AS json, "
            f"count(*) FILTER (WHERE {ap}) AS apache, count(*) AS n FROM lines_{f}")


@register("s19_detect_format", FX.with_requests(f"""
SELECT line_set, CASE WHEN greatest(alb, json, apache) = 0 THEN 'GROK' WHEN alb = greatest(alb, json, apache) THEN 'ALB'
                      WHEN json = greatest(alb, json, apache) THEN 'JSON' ELSE 'APACHE' END AS log_type,
       {r("CASE WHEN greatest(alb, json, apache) = 0 THEN 0.1 ELSE greatest(alb, json, apache) / n END", "confidence")},
       alb, json, apache, n
FROM ({' UNION ALL '.join(_detect_sql(f) for f in FX.LINE_FORMATS)})""",
    ",\n".join(FX.lines_cte(f, junk=False).replace("lines AS (", f"raw_{f} AS (", 1)
               + f",\nlines_{f} AS (SELECT v AS value FROM (SELECT regexp_replace(value, '^{WS}+|{WS}+$', '', 'g') "
               f"AS v FROM raw_{f}) WHERE v <> '')" for f in FX.LINE_FORMATS)))
def s19_detect_format(spark, sf):
    out = None
    for f in FX.LINE_FORMATS:
        d = TX.detect_format(land_lines(spark, sf, f, junk=False), sample=None).withColumn("line_set", F.lit(f))
        out = d if out is None else out.unionByName(d)
    return normalized(out)


def _rates_sql() -> str:
    parts = []
    for f in FX.LINE_FORMATS:
        for name, fmt in PRESETS.items():
            hit = (f"TRY_CAST(json_valid(value) AS INTEGER)" if fmt.pattern_type == "JSON"
                   else f"CAST(regexp_matches(value, {duck.sql_str('^(?:' + fmt.pattern + ')')}) AS INTEGER)")
            parts.append(f"SELECT '{f}' AS line_set, '{name}' AS format, {r(f'avg({hit})', 'success_rate')} "
                         f"FROM lines_{f}")
    return " UNION ALL ".join(parts)


@register("s20_success_rates", FX.with_requests(_rates_sql(), ",\n".join(
    FX.lines_cte(f).replace("lines AS (", f"raw_{f} AS (", 1)
    + f",\nlines_{f} AS (SELECT v AS value FROM (SELECT regexp_replace(value, '^{WS}+|{WS}+$', '', 'g') "
    f"AS v FROM raw_{f}) WHERE v <> '')" for f in FX.LINE_FORMATS)))
def s20_success_rates(spark, sf):
    out = None
    for f in FX.LINE_FORMATS:
        d = TX.format_success_rates(land_lines(spark, sf, f), sample=None).withColumn("line_set", F.lit(f))
        out = d if out is None else out.unionByName(d)
    return normalized(out)


@register("s25_parse_preview", _sql("nginx", f"""
SELECT value, m AS matched, CASE WHEN m THEN concat_ws('|', {", ".join(f"g['{c}']" for c in _NGX.columns)}) END AS groups FROM (
  SELECT value, regexp_matches(value, {duck.sql_str('^(?:' + _NGX.pattern + ')')}) AS m,
         regexp_extract(value, {duck.sql_str('^(?:' + _NGX.pattern + ')')}, [{", ".join(duck.sql_str(c) for c in _NGX.columns)}]) AS g FROM lines)"""))
def s25_parse_preview(spark, sf):
    p = TX.parse_preview(land_lines(spark, sf, "nginx"), _NGX)
    return p.select("value", "matched", F.array_join("groups", "|").alias("groups"))


def _line_type_sql() -> str:
    lt = (f"CASE WHEN starts_with(value, '{{') THEN 'JSON' WHEN regexp_matches(value, {duck.sql_str(TX.LINE_ALB)}) "
          f"THEN 'ALB' WHEN regexp_matches(value, {duck.sql_str(TX.LINE_CLF)}) THEN 'CLF' ELSE 'UNKNOWN' END")
    return " UNION ALL ".join(
        f"SELECT '{f}' AS line_set, {lt} AS line_type, count(*) AS n FROM lines_{f} GROUP BY 2"
        for f in FX.LINE_FORMATS)


@register("l7_line_types", FX.with_requests(_line_type_sql(), ",\n".join(
    FX.lines_cte(f).replace("lines AS (", f"raw_{f} AS (", 1)
    + f",\nlines_{f} AS (SELECT v AS value FROM (SELECT regexp_replace(value, '^{WS}+|{WS}+$', '', 'g') "
    f"AS v FROM raw_{f}) WHERE v <> '')" for f in FX.LINE_FORMATS)))
def l7_line_types(spark, sf):
    out = None
    for f in FX.LINE_FORMATS:
        d = (land_lines(spark, sf, f).groupBy(TX.line_type(F.col("value")).alias("line_type"))
             .agg(F.count(F.lit(1)).alias("n")).withColumn("line_set", F.lit(f)))
        out = d if out is None else out.unionByName(d)
    return out


@register("p16_clf_trailing_micros", _sql("httpd_with_time", f"""
SELECT value, {r("CASE WHEN regexp_matches(trim(regexp_extract(value, " + duck.sql_str(TX.LINE_CLF) + ", 8)), '(^|\\s)[0-9]+$') "
               "THEN CAST(regexp_extract(trim(regexp_extract(value, " + duck.sql_str(TX.LINE_CLF) + ", 8)), '([0-9]+)$', 1) AS DOUBLE) / 1000000.0 "
               "ELSE 0.0 END", "seconds")}
FROM lines WHERE regexp_matches(value, {duck.sql_str(TX.LINE_CLF)})"""))
def p16_clf_trailing_micros(spark, sf):
    lines = land_lines(spark, sf, "httpd_with_time")
    s = TX.clf_response_seconds(F.col("value"))
    return normalized(lines.filter(F.col("value").rlike(TX.LINE_CLF)).select("value", s.alias("seconds")))
