"""Folders of mixed logs: one format per file, one plan for all.

``file_formats`` scores every file on its own, in one pass over the lines:
a row per file, partially aggregated on the map side.  ``parse_mixed`` joins the
chosen format to the lines and dispatches inside one expression, so a folder is
scanned once more, and a line meets the regex of its own file's format only.
Records of all formats have one type, the columns of ``FIELDS``.

Every line is a record or a reject: a file that no format fits is rejected
whole, with format ``raw``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.sources.formats import PRESETS, LogFormat
from reqlens.sources.text import JSON_ROLE_KEYS, SEP, _split_request, _typed, line_scores, null_token

#: formats tried for Apache-style files; the first of equally good ones is taken
APACHE_FORMATS = ("httpd_with_time", "nginx", "httpd_custom", "httpd")
RAW = "raw"
#: the common record; times are seconds, ``time`` is an instant
FIELDS = {"time": "timestamp", "client_ip": "string", "request_verb": "string", "request_url": "string", "status": "bigint",
          "sent_bytes": "bigint", "received_bytes": "bigint", "request_processing_time": "double",
          "target_processing_time": "double", "response_processing_time": "double", "user_agent": "string"}
#: columns of a preset that stand for a field of another name
_AS = {"request_method": "request_verb", "elb_status_code": "status", "bytes_sent": "sent_bytes",
       "response_time_us": "target_processing_time", "request_time": "target_processing_time"}
_PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000}
_JSON_KEYS = {"time": JSON_ROLE_KEYS["timestamp"], "client_ip": JSON_ROLE_KEYS["clientIp"], "request_verb": JSON_ROLE_KEYS["method"],
              "request_url": JSON_ROLE_KEYS["url"], "status": JSON_ROLE_KEYS["status"],
              "target_processing_time": JSON_ROLE_KEYS["responseTime"], "sent_bytes": ["bytes_sent", "sent_bytes", "bytes"],
              "received_bytes": ["received_bytes"], "user_agent": ["user_agent"]}


@dataclass
class MixedResult:
    records: DataFrame
    rejected: DataFrame
    formats: DataFrame
    lines: DataFrame        # every line with its ``record``, null for a reject: both in one pass


def file_formats(lines: DataFrame) -> DataFrame:
    """``(file, format, log_type, confidence, success_rate, n)`` per file."""
    v = F.col("value")
    alb, js, ap = line_scores(v)
    # no Apache-style line lacks a bracket or a quote, so most lines of other kinds meet no regex
    framed = v.contains("[") & v.contains('"')
    hits = {f: F.count_if(framed & v.rlike(f"^(?:{PRESETS[f].pattern})")).alias(f) for f in APACHE_FORMATS}
    s = lines.groupBy("file").agg(
        F.count_if(alb).alias("alb"), F.count_if(js).alias("json"), F.count_if(ap).alias("apache"), F.count(F.lit(1)).alias("n"),
        F.count_if(alb & v.rlike(f"^(?:{PRESETS['alb'].pattern})")).alias("__alb"), *hits.values())
    best, fit = F.greatest("alb", "json", "apache"), F.greatest(*APACHE_FORMATS)
    kind = (F.when(best == 0, F.lit("GROK")).when(F.col("alb") == best, F.lit("ALB"))
            .when(F.col("json") == best, F.lit("JSON")).otherwise(F.lit("APACHE")))
    apache = F.lit(RAW)
    for f in reversed(APACHE_FORMATS):
        apache = F.when((F.col(f) == fit) & (fit > 0), F.lit(f)).otherwise(apache)
    chosen = (F.when(F.col("log_type") == "ALB", F.lit("alb")).when(F.col("log_type") == "JSON", F.lit("json"))
              .when(F.col("log_type") == "APACHE", apache).otherwise(F.lit(RAW)))
    right = F.when(F.col("format") == "alb", F.col("__alb")).when(F.col("format") == "json", F.col("json")).when(
        F.col("format") != RAW, fit).otherwise(F.lit(0))
    return (s.withColumn("log_type", kind).withColumn("format", chosen)
            .select("file", "format", "log_type", F.when(best == 0, F.lit(0.1)).otherwise(best / F.col("n")).alias("confidence"),
                    (right / F.col("n")).alias("success_rate"), "n"))


def _groups(fmt: LogFormat) -> list[tuple[str, int]]:
    """(field, group) of a preset; ``request`` is split later."""
    named = [(_AS.get(c, c), i) for i, c in enumerate(fmt.columns, 1)]
    return [(c, i) for c, i in named if c in FIELDS or c == "request"]


def _record(fmt: LogFormat, parts: Column) -> tuple[Column, Column]:
    """The record of a matched line and whether it is a valid one."""
    text = {c: null_token(F.element_at(parts, k)) for k, (c, _) in enumerate(_groups(fmt), 1)}
    if "request" in text:
        text["request_verb"], text["request_url"], _ = _split_request(text["request"])
    out = []
    for c, kind in FIELDS.items():
        raw = text.get(c, F.lit(None).cast("string"))
        if c == "time":
            value = _typed(raw, "datetime", fmt).cast("timestamp")
        elif c == "target_processing_time":
            value = raw.try_cast("double") / _PER_SECOND[fmt.rt_unit]
        else:
            value = raw.try_cast(kind)
        out.append(value.alias(c))
    must = ("time", "request_url", "request_verb") if fmt.pattern_type == "ALB" else ("time", "status")
    return F.struct(*out), F.coalesce(*(text[c] for c in must)).isNotNull()


def _json_record(obj: Column) -> Column:
    out = []
    for c, kind in FIELDS.items():
        raw = F.coalesce(*(obj[k] for k in _JSON_KEYS[c])) if c in _JSON_KEYS else F.lit(None).cast("string")
        value = F.try_to_timestamp(raw) if c == "time" else raw.try_cast(kind)
        out.append((value / _PER_SECOND[PRESETS["json"].rt_unit] if c == "target_processing_time" else value).alias(c))
    return F.struct(*out)


def parse_mixed(lines: DataFrame, formats: DataFrame | None = None) -> MixedResult:
    """Records and rejects of all files, each by its own format.

    ``lines`` has ``file`` and ``value``; further columns come along.
    ``formats`` (file, format) overrides the detection.  Rejects keep the file's format."""
    formats = file_formats(lines) if formats is None else formats
    keep = [c for c in lines.columns if c != "value"] + ["format"]
    used = {f: PRESETS[f] for f in ("alb", *APACHE_FORMATS)}
    value, kind = F.col("value"), F.col("format")
    odd = value.contains(SEP)           # a line that holds the separator has its groups extracted one by one
    rewritten = parts_of_odd = None
    for name, fmt in used.items():
        whole, groups = f"(?s)^(?:{fmt.pattern}).*$", [i for _, i in _groups(fmt)]
        text = F.regexp_replace(value, whole, SEP + SEP.join(f"${i}" for i in groups))
        each = F.when(value.rlike(whole), F.array(*(F.regexp_extract(value, whole, i) for i in groups)))
        own, other = (kind == name) & ~odd, (kind == name) & odd
        rewritten = F.when(own, text) if rewritten is None else rewritten.when(own, text)
        parts_of_odd = F.when(other, each) if parts_of_odd is None else parts_of_odd.when(other, each)
    keys = list(dict.fromkeys(k for ks in _JSON_KEYS.values() for k in ks))
    schema = ", ".join(f"`{k}` STRING" for k in [*keys, "_broken"])
    obj = F.when((kind == "json") & value.startswith("{"),
                 F.from_json(value, schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    # a row per file, no more than the listing that Spark's reader holds
    stage = (lines.join(F.broadcast(formats.select("file", "format")), "file")
             .select(*keep, "value", rewritten.alias("__o"), parts_of_odd.alias("__e"), obj.alias("__j"))
             .select(*keep, "value", "__j", F.when(F.col("__o").startswith(SEP), F.split(F.substr("__o", F.lit(2)), SEP, -1))
                     .otherwise(F.col("__e")).alias("__p")))
    record = F.when((kind == "json") & F.col("__j").isNotNull() & F.col("__j._broken").isNull(), _json_record(F.col("__j")))
    for name, fmt in used.items():
        fields, valid = _record(fmt, F.col("__p"))
        record = record.when((kind == name) & F.col("__p").isNotNull() & valid, fields)
    judged = stage.select(*keep, "value", record.alias("__r"))
    # generators, not filters: the optimizer cannot copy the regexes into pushed-down predicates
    records = judged.select(*keep, F.inline(F.when(F.col("__r").isNotNull(), F.array("__r"))))
    rejected = judged.select(*keep, F.explode(F.when(F.col("__r").isNull(), F.array("value"))).alias("value"))
    every = judged.select(*keep, F.inline(F.array(F.struct("value", F.col("__r").alias("record")))))
    return MixedResult(records, rejected, formats, every)
