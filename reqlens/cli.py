"""Command line: ``python -m reqlens <command> <log paths...> [options]``.

Each command reads the logs (format given or detected), runs one operator
family as a Spark job and writes its result with the sinks (JSON lines or
CSV) under ``--out``.  Column names come from the format's field map, with
the usual fallbacks.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from reqlens.functions.fields import find_field, require_field
from reqlens.functions.urls import Rule, rules_from_patterns
from reqlens.operators import filters as FL
from reqlens.operators import pivot as PV
from reqlens.operators import series as SE
from reqlens.operators import stats as ST
from reqlens.sinks import writers as W
from reqlens.sources import text as TX


def _fields(res: TX.ParseResult, a) -> dict[str, str | None]:
    cols, fm = res.records.columns, res.format.field_map
    return {"time": a.time or find_field(cols, "timestamp", fm), "url": find_field(cols, "url", fm),
            "status": find_field(cols, "status", fm), "rt": find_field(cols, "responseTime", fm),
            "ip": find_field(cols, "clientIp", fm)}


def _read(spark, a) -> TX.ParseResult:
    return TX.read_requests(spark, a.paths, fmt=a.format, apache_format=a.apache_format,
                            log_regex=a.log_regex, partitions=a.partitions)


def _rules(spark, a) -> list[Rule] | None:
    """The rules of ``--rules``, a file of URI patterns in order of precedence."""
    return rules_from_patterns(FL.read_uri_patterns(spark, a.rules)) if a.rules else None


def _write(df: DataFrame, out: str, csv: bool = False, sep: str = ",") -> str:
    return W.write_csv(df, out, sep=sep) if csv else W.write_json_lines(df, out)


def cmd_detect(spark, a) -> dict:
    lines = TX.read_lines(spark, a.paths)
    d = TX.detect_format(lines).first().asDict()
    d["success_rates"] = {r["format"]: r["success_rate"] for r in TX.format_success_rates(lines).collect()}
    return d


def cmd_filter(spark, a) -> dict:
    res = _read(spark, a)
    f = _fields(res, a)
    df = res.records
    if a.start or a.end:
        df = FL.filter_time(df, a.start, a.end, time=f["time"], log_tz=a.log_tz)
    if a.status:
        df = FL.filter_status(df, a.status, f["status"])
    if a.min or a.max or a.min_ms is not None or a.max_ms is not None:
        df = FL.filter_response_time(df, a.min, a.max, a.min_ms, a.max_ms, rt=f["rt"], unit=res.format.rt_unit)
    if a.client:
        df = FL.filter_client(df, a.client, f["ip"])
    if a.urls_file:
        df = FL.filter_urls(df, FL.read_url_list(spark, a.urls_file), f["url"])
    if a.uri_patterns:
        df = FL.filter_uri_patterns(df, a.uri_patterns.split(","), f["url"])
    if a.uri_patterns_file:
        df = FL.filter_uri_patterns(df, FL.read_uri_patterns(spark, a.uri_patterns_file), f["url"])
    return {"path": _write(df, a.out)}


def cmd_stats(spark, a) -> dict:
    res = _read(spark, a)
    f = _fields(res, a)
    secs = ST.calculate_stats(res.records, a.types.split(","), url=f["url"], time=f["time"], status=f["status"],
                              rt=f["rt"], client_ip=f["ip"], interval=a.interval,
                              processing_fields=[x for x in (a.fields or "").split(",") if x],
                              sort_by=a.sort_by, sort_metric=a.sort_metric, top_n=a.top,
                              materialize="snapshot")
    return W.write_sections(secs, a.out)


def cmd_patterns(spark, a) -> dict:
    res = _read(spark, a)
    f = _fields(res, a)
    pats = ST.uri_patterns(res.records, f["url"], a.include_params, a.min_count, a.max_count, a.max, _rules(spark, a))
    # rules that an earlier run left come first; the merge is read from their old folder and so lands beside it
    old = _stored_rules(spark, f"{a.out}/rules")
    rules = SE.update_rule_store(spark, old, pats.withColumnRenamed("pattern", SE.LABEL))
    if old is not None:
        rules = spark.createDataFrame(rules.collect(), rules.schema)     # a rule list: as small as the leaders it came from
    return {"patterns": _write(pats, f"{a.out}/patterns"), "rules": W.save_rules(rules, f"{a.out}/rules")}


def _stored_rules(spark, path: str) -> DataFrame | None:
    try:
        return W.load_rules(spark, path)
    except AnalysisException:            # no earlier run
        return None


def cmd_pivot(spark, a) -> dict:
    res = _read(spark, a)
    f = _fields(res, a)
    alias = {"url": f["url"], "time": f["time"], "status": f["status"], "client_ip": f["ip"]}
    row, col = alias.get(a.row, a.row), alias.get(a.col, a.col)
    long = PV.pivot_long(res.records, row, col, a.value, a.agg, interval=a.interval if col == f["time"] else None,
                         status_groups=a.status_groups.split(",") if a.status_groups else None,
                         row_filter=a.row_filter, top_n=a.top or 20, status=f["status"])
    return {"path": _write(long, a.out)}


def cmd_series(spark, a) -> dict:
    res = _read(spark, a)
    f = _fields(res, a)
    df, n, rules = res.records, a.top or 20, _rules(spark, a)
    if a.kind == "uri":
        out = SE.requests_per_uri(df, f["time"], f["url"], a.interval, n, rules)
    elif a.kind == "target":
        out = SE.requests_per_target(df, f["time"], require_field(df, "target_ip"), require_field(df, "target_port"),
                                     interval=a.interval, top_n=n)
    elif a.kind == "client":
        out = SE.requests_per_client(df, f["time"], f["ip"], a.interval, n)
    elif a.kind in ("received_bytes", "sent_bytes"):
        out, _ = SE.bytes_per_uri(df, require_field(df, a.kind), f["time"], f["url"], a.interval, n, rules)
    else:
        out = SE.processing_time_per_uri(df, a.field or f["rt"], a.metric, f["time"], f["url"], a.interval, n, rules)
    return {"path": _write(out, a.out)}


def cmd_export(spark, a) -> dict:
    res = _read(spark, a)
    return {"path": _write(res.records, a.out, csv=True, sep=a.sep)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reqlens")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, fn, out=True):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="+")
        s.add_argument("--format")
        s.add_argument("--apache-format")
        s.add_argument("--log-regex")
        s.add_argument("--partitions", type=int)
        s.add_argument("--time", help="time field, e.g. request_creation_time; by default the format's")
        if out:
            s.add_argument("--out", required=True)
        s.set_defaults(fn=fn)
        return s

    add("detect", cmd_detect, out=False)
    s = add("filter", cmd_filter)
    for o in ("--start", "--end", "--status", "--min", "--max", "--client", "--urls-file", "--uri-patterns",
              "--uri-patterns-file"):
        s.add_argument(o)
    s.add_argument("--min-ms", type=float)
    s.add_argument("--max-ms", type=float)
    s.add_argument("--log-tz", default="UTC")
    s = add("stats", cmd_stats)
    s.add_argument("--types", default="all")
    s.add_argument("--interval", default="10m")
    s.add_argument("--fields")
    s.add_argument("--sort-by")
    s.add_argument("--sort-metric", default="avg")
    s.add_argument("--top", type=int)
    s = add("patterns", cmd_patterns)
    s.add_argument("--include-params", action="store_true")
    s.add_argument("--min-count", type=int, default=1)
    s.add_argument("--max-count", type=int)
    s.add_argument("--max", type=int, default=100)
    s.add_argument("--rules")
    s = add("pivot", cmd_pivot)
    s.add_argument("--row", required=True)
    s.add_argument("--col", required=True)
    s.add_argument("--value", default="count")
    s.add_argument("--agg", default="count")
    s.add_argument("--interval", default="10m")
    s.add_argument("--status-groups")
    s.add_argument("--row-filter")
    s.add_argument("--top", type=int)
    s = add("series", cmd_series)
    s.add_argument("--kind", default="uri",
                   choices=["uri", "target", "client", "received_bytes", "sent_bytes", "processing_time"])
    s.add_argument("--interval", default="10s")
    s.add_argument("--top", type=int)
    s.add_argument("--field")
    s.add_argument("--metric", default="avg")
    s.add_argument("--rules")
    s = add("export", cmd_export)
    s.add_argument("--sep", default=",")
    return p


def main(argv: list[str] | None = None, spark=None) -> dict:
    a = parser().parse_args(argv)
    if spark is None:
        from reqlens.session import get_spark
        spark = get_spark()
    result = a.fn(spark, a)
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
