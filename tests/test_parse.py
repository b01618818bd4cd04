"""Parsing, modelled on the reference's 3-line fixtures (our own sample lines)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reqlens.sources import formats as FM
from reqlens.sources import text as TX

ALB_LINES = [
    'https 2024-08-08T09:00:01.123456Z app/lb/abc 10.0.0.1:4000 10.1.0.5:80 0.001 0.250 0.000 200 200 120 3400 '
    '"GET https://ex.com:443/api/users/42?x=1 HTTP/1.1" "curl/8" ECDHE-RSA-AES128-GCM-SHA256 TLSv1.2',
    'http 2024-08-08T09:00:02.000000Z app/lb/abc 10.0.0.2:4001 - -1 -1 -1 503 - 10 0 '
    '"POST http://ex.com:80/login HTTP/1.1" "-" - -',
    "not an alb line at all",
]
APACHE_LINES = [
    '116.33.12.98 - - [12/Dec/2021:03:13:02 +0900] "POST /path/a HTTP/1.1" 200 117 "http://r/" "Mozilla/5.0"',
    '10.118.5.174 - - [12/Dec/2021:03:13:43 +0900] "-" 408 - "-" "-"',
    '10.0.0.9 - bob [12/Dec/2021:03:14:00 +0000] "GET /only" 404 0',
]
JSON_LINES = [
    '{"timestamp": "2024-08-08T09:00:00Z", "method": "GET", "url": "/a", "status": 200, "response_time": 12.5}',
    '{"timestamp": "2024-08-08T09:00:01Z", "method": "POST", "url": "/b", "status": 500, "response_time": 80}',
    "{broken json",
]


def _lines(spark, items):
    return TX.lines_frame(spark.createDataFrame([(x,) for x in items], "value STRING"))


def test_alb_parse_types_and_nulls(spark):
    res = TX.parse_lines(_lines(spark, ALB_LINES), FM.preset("alb"))
    recs = res.records.orderBy("client_port").collect()
    assert len(recs) == 2 and res.rejected.count() == 1
    a, b = recs
    assert a["time"] == dt.datetime(2024, 8, 8, 9, 0, 1, 123456)
    assert a["target_port"] == 80 and a["target_processing_time"] == 0.25 and a["elb_status_code"] == 200
    assert a["request_url"] == "https://ex.com:443/api/users/42?x=1" and a["request_verb"] == "GET"
    assert b["target_ip"] is None and b["target_port"] is None and b["target_status_code"] is None
    assert b["user_agent"] is None and b["trace_id"] is None      # optional tail absent


def test_alb_column_pruning(spark):
    res = TX.parse_lines(_lines(spark, ALB_LINES), FM.preset("alb"), columns=["time", "request_url"])
    assert res.records.columns == ["time", "request_url"]
    assert res.records.count() == 2


def test_httpd_request_split_and_zone(spark):
    res = TX.parse_lines(_lines(spark, APACHE_LINES), FM.preset("httpd"))
    got = {r["client_ip"]: r for r in res.records.collect()}
    a = got["116.33.12.98"]
    assert (a["request_method"], a["request_url"], a["request_proto"]) == ("POST", "/path/a", "HTTP/1.1")
    assert a["time"] == dt.datetime(2021, 12, 11, 18, 13, 2)      # +0900 → UTC instant
    assert a["referer"] == "http://r/" and a["bytes_sent"] == 117
    b = got["10.118.5.174"]
    assert b["request"] is None and b["request_url"] is None and b["bytes_sent"] is None and b["status"] == 408
    c = got["10.0.0.9"]
    assert (c["request_method"], c["request_url"], c["request_proto"]) == ("GET", "/only", None)
    assert c["user"] == "bob" and c["referer"] is None


def test_httpd_with_time_has_identity_captured():
    f = FM.preset("httpd_with_time")
    assert f.n_groups == len(f.columns) == 12
    for name, p in FM.PRESETS.items():
        if p.pattern_type != "JSON":
            assert p.n_groups == len(p.columns), name


def test_json_lines_and_rejects(spark):
    res = TX.parse_json_lines(_lines(spark, JSON_LINES))
    recs = res.records.orderBy("url").collect()
    assert [r["status"] for r in recs] == [200, 500]
    assert recs[0]["response_time"] == 12.5 and recs[1]["response_time"] == 80.0
    assert recs[0]["timestamp"] == dt.datetime(2024, 8, 8, 9, 0)
    assert res.rejected.count() == 1
    assert TX.json_field_map(_lines(spark, JSON_LINES))["responseTime"] == "response_time"


def test_json_defaults(spark):
    lines = _lines(spark, ['{"time": "2024-01-01T00:00:00Z", "path": "/p", "status": 0, "duration": "0.5"}',
                           '{"datetime": "x", "url": "", "request_uri": "/u", "client_ip": "1.2.3.4", "bytes_sent": 9}'])
    got = {r["url"]: r for r in TX.json_defaults(lines).collect()}
    assert got["/p"]["status"] == "200" and got["/p"]["method"] == "GET" and got["/p"]["response_time"] == 0.5
    assert got["/p"]["client_ip"] == "unknown" and got["/p"]["bytes"] == 0.0
    assert got["/u"]["time"] == "x" and got["/u"]["bytes"] == 9.0


def test_detection(spark):
    assert TX.detect_format(_lines(spark, ALB_LINES)).first()["log_type"] == "ALB"
    assert TX.detect_format(_lines(spark, APACHE_LINES)).first()["log_type"] == "APACHE"
    d = TX.detect_format(_lines(spark, JSON_LINES)).first()
    assert d["log_type"] == "JSON" and abs(d["confidence"] - 2 / 3) < 1e-9
    assert TX.detect_format(_lines(spark, ["hello world"])).first()["log_type"] == "GROK"
    assert TX.resolve_format(_lines(spark, APACHE_LINES)).pattern_type == "HTTPD"


def test_resolution_precedence(spark):
    lines = _lines(spark, APACHE_LINES)
    f = TX.resolve_format(lines, log_regex=r"(?P<ip>\S+) .*", apache_format="common")
    assert f.columns == ("ip",)                                     # regex wins over LogFormat
    assert TX.resolve_format(lines, apache_format="common").columns[-1] == "bytes_sent"


def test_apache_logformat_compiler():
    f = FM.compile_apache_format('%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i" %D %{X-Id}o %{HOME}e')
    assert f.columns == ("client_ip", "identity", "user", "time", "request", "status", "bytes_sent", "referer",
                         "user_agent", "response_time_us", "resp_x_id", "env_home")
    assert f.types["status"] == "int" and f.types["time"] == "datetime" and f.rt_unit == "us"
    assert f.n_groups == len(f.columns)
    assert FM.compile_apache_format("combined").columns[-1] == "user_agent"


def test_custom_named_groups(spark):
    f = FM.custom_format(r"(?P<client_ip>\S+) \S+ (?P<who>\S+)")
    assert f.columns == ("client_ip", "who")
    rec = TX.parse_lines(_lines(spark, APACHE_LINES), f).records.orderBy("client_ip").collect()
    assert rec[-1]["client_ip"] == "116.33.12.98" and rec[-1]["who"] is None


def test_fallback_without_columns(spark):
    f = FM.LogFormat("x", FM.ALB_PATTERN, (), {}, "ALB")
    rec = TX.parse_lines(_lines(spark, ALB_LINES), f).records.collect()
    assert len(rec) == 2 and "request_url" in rec[0].asDict() and len(rec[0]["_extra_groups"]) == 17


def test_line_type_and_preview(spark):
    lines = _lines(spark, ALB_LINES + APACHE_LINES + JSON_LINES)
    kinds = sorted(r[0] for r in lines.select(TX.line_type(F.col("value"))).collect())
    # the common-log base pattern wants a tail after the byte count, so the
    # bare "404 0" line is UNKNOWN, like the prose line
    assert kinds.count("ALB") == 2 and kinds.count("CLF") == 2 and kinds.count("JSON") == 3
    assert kinds.count("UNKNOWN") == 2
    p = TX.parse_preview(_lines(spark, APACHE_LINES), FM.preset("httpd")).collect()
    assert all(r["matched"] for r in p) and len(p[0]["groups"]) == 9


def test_read_lines_gzip(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "a.log.gz", "wt") as fh:
        fh.write("\n".join(APACHE_LINES) + "\n\n   \n")
    (tmp_path / "b.log").write_text(ALB_LINES[0] + "\n")
    lines = TX.read_lines(spark, str(tmp_path / "*.log*"))
    assert lines.count() == 4


def test_read_requests_end_to_end(spark, tmp_path):
    (tmp_path / "access.log").write_text("\n".join(APACHE_LINES) + "\n")
    res = TX.read_requests(spark, str(tmp_path / "access.log"), partitions=3)
    assert res.format.pattern_type == "HTTPD"
    assert res.records.count() == 3 and res.rejected.count() == 0
    res = TX.read_requests(spark, str(tmp_path / "access.log"), fmt="httpd", columns=["time", "status"])
    assert res.records.columns == ["file", "time", "status", "request_method", "request_url", "request_proto"]


def test_apache_literal_percent_and_unknown_directive():
    f = FM.compile_apache_format("%h 100%% %Z %D")
    assert f.columns == ("client_ip", "response_time_us") and "100%" in f.pattern


def test_recommend_format(spark):
    rec = TX.recommend_format(_lines(spark, ALB_LINES))
    assert rec["format"] == "alb" and rec["success_rate"] == pytest.approx(2 / 3)
    assert rec["score"] == pytest.approx(rec["confidence"] * rec["success_rate"])
    rec = TX.recommend_format(_lines(spark, APACHE_LINES))
    assert rec["pattern_type"] == "HTTPD" and rec["success_rate"] > 0


def test_groups_separators_and_repeated_keys(spark):
    mixed = FM.custom_format(r"(\S+) (?P<ident>\S+) (?P<user>\S+)")
    got = TX.parse_lines(_lines(spark, ["ip1 id1 us1", "a\u0001b id us", "short"]), mixed)
    assert sorted(map(tuple, got.records.collect())) == [("id", "us"), ("id1", "us1")]
    assert [r["value"] for r in got.rejected.collect()] == ["short"]
    both = FM.compile_apache_format("%h %a %s %>s %{User}n%b")
    row = TX.parse_lines(_lines(spark, ["1.1.1.1 2.2.2.2 301 200 17"]), both).records.first()
    assert (row["client_ip"], row["status"], row["bytes_sent"]) == ("2.2.2.2", 200, 17)
    rows = TX.parse_lines(_lines(spark, ['{"a":1,"a":2}', '{"a":3,"b":1}']), FM.preset("json"), columns=["a"])
    assert rows.records.columns == ["a"] and sorted(r["a"] for r in rows.records.collect()) == [2, 3]


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace
    from reqlens.session import ensure_checkpoint_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None,
                              getConf=lambda: SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_a_hundred_thousand_json_keys(spark, tmp_path):
    """Objects of any keys parse, one parse per line, and keep every value."""
    lines = spark.range(1000).selectExpr(
        "concat('{\"timestamp\": \"2024-01-01T00:00:00Z\", \"status\": ', id, ', ', array_join(transform(sequence(0, 99), "
        "i -> concat('\"k', id * 100 + i, '\": ', i)), ', '), '}') value").union(spark.createDataFrame([("{broken",), ("text",)], "value string"))
    lines.write.text(str(tmp_path / "lines"))
    res = TX.parse_json_lines(TX.read_lines(spark, str(tmp_path / "lines")), keep=[])
    assert res.rejected.count() == 2 and "record" in res.records.columns
    res.records.write.parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    keys = TX.open_keys(landed)
    assert keys.count() == 100_002
    assert {tuple(r) for r in keys.where("key IN ('status', 'k77')").collect()} == {("status", "bigint", 1000), ("k77", "bigint", 1)}
    got = TX.shred(landed.select("timestamp", "record"), {"k12345": "bigint", "status": "int"}).where("k12345 IS NOT NULL").collect()
    assert [(r["k12345"], r["status"], r["timestamp"].year) for r in got] == [(45, 123, 2024)]
    plan = res.records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_json_keys_in_order_with_merged_types(spark):
    lines = spark.createDataFrame([('{"z": 1, "a": 2.5, "m": true}',), ('{"a": 1, "z": "x", "n": null}',), ("[1]",)], "value string").coalesce(1)
    assert TX.infer_json_fields(lines) == [("z", "string"), ("a", "double"), ("m", "boolean"), ("n", "string")]
    assert TX.parse_json_lines(lines, columns=["a"]).records.columns == ["a"]
    assert TX.infer_json_fields(lines.limit(0)) == []
