"""Mixed folders and line numbers."""

import gzip

import pytest

from reqlens.sources import mixed as MX
from reqlens.sources import numbered as NB
from reqlens.sources import text as TX
from reqlens.sources.formats import PRESETS

ALB = ('http 2024-01-01T00:00:0{}.000000Z app/lb/1 10.0.0.1:1 10.0.0.2:80 0.001 0.25 0.001 200 200 10 20 "GET https://e.com/a{} HTTP/1.1" '
       '"ua" ECDHE TLSv1.2')
CLF = '10.0.0.3 - - [01/Jan/2024:00:00:0{} +0000] "POST /b{} HTTP/1.1" 404 7 "-" "agent"'
TIMED = CLF + " 1500"
JSON = '{{"time": "2024-01-01T00:00:0{}Z", "uri": "/c{}", "status_code": 500, "duration": 20}}'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("mixed")
    files = {"alb.log": [ALB.format(i, i) for i in range(3)] + ["http broken"], "clf.log": [CLF.format(i, i) for i in range(2)],
             "timed.log": [TIMED.format(i, i) for i in range(4)] + ["x\u0001y"], "j.log": [JSON.format(i, i) for i in range(2)] + ['{"uri": "/old", "uri": "/last"}', '{"broken'],
             "notes.log": ["nothing here", "a [b] \"c\""]}
    for name, lines in files.items():
        (d / name).write_text("\n".join(lines) + "\n\n")
    return str(d), files


def test_each_file_has_its_own_format(spark, folder):
    path, files = folder
    lines = TX.read_lines(spark, f"{path}/*")
    got = {r["file"].rsplit("/")[-1]: r for r in MX.file_formats(lines).collect()}
    assert {f: r["format"] for f, r in got.items()} == {
        "alb.log": "alb", "clf.log": "httpd", "timed.log": "httpd_with_time", "j.log": "json", "notes.log": "raw"}
    assert got["alb.log"]["success_rate"] == 0.75 and got["timed.log"]["n"] == 5


def test_no_line_is_lost(spark, folder):
    path, files = folder
    res = MX.parse_mixed(TX.read_lines(spark, f"{path}/*"))
    records = res.records.collect()
    assert len(records) == 12 and len(records) + res.rejected.count() == sum(map(len, files.values()))
    by = {}
    for r in records:
        by.setdefault(r["format"], []).append(r)
    assert {r["request_url"] for r in by["alb"]} == {f"https://e.com/a{i}" for i in range(3)}
    assert all((r["status"], r["target_processing_time"], r["sent_bytes"], r["request_verb"]) == (200, 0.25, 20, "GET") for r in by["alb"])
    assert {(r["request_url"], r["status"], r["target_processing_time"]) for r in by["httpd_with_time"]} == {(f"/b{i}", 404, 0.0015) for i in range(4)}
    assert {(r["request_url"], r["request_verb"], r["user_agent"]) for r in by["httpd"]} == {(f"/b{i}", "POST", "agent") for i in range(2)}
    assert {(r["request_url"], r["status"], r["target_processing_time"]) for r in by["json"]} == {
        *((f"/c{i}", 500, 0.02) for i in range(2)), ("/last", None, None)}
    assert {(r["file"].rsplit("/")[-1], r["value"]) for r in res.rejected.collect()} == {
        ("alb.log", "http broken"), ("timed.log", "x\u0001y"), ("j.log", '{"broken'), *(("notes.log", x) for x in files["notes.log"])}


def test_one_scan_and_one_regex_a_line(spark, folder):
    plan = MX.parse_mixed(TX.read_lines(spark, f"{folder[0]}/*"), spark.createDataFrame(
        [("f", "alb")], "file string, format string")).records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("split", ["50", "100000"])
def test_line_numbers_over_splits(spark, tmp_path, split):
    """Rejects have the number an editor shows, with blank lines, CR LF, a
    gzip file and files cut into many splits."""
    bodies = {"a.log": [ALB.format(i % 10, i) if i % 4 else "junk %d" % i for i in range(40)],
              "b.log": ["", "x 1", "", ALB.format(1, 1), "  ", "x 2"], "c.log.gz": ["z", "", ALB.format(1, 1), "zz"]}
    (tmp_path / "a.log").write_text("\n".join(bodies["a.log"]) + "\n")
    (tmp_path / "b.log").write_bytes("\r\n".join(bodies["b.log"]).encode())
    with gzip.open(tmp_path / "c.log.gz", "wt") as f:
        f.write("\n".join(bodies["c.log.gz"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = NB.read_numbered(spark, f"{tmp_path}/*")
        bad = NB.with_line_numbers(TX.parse_lines(lines, PRESETS["alb"]).rejected, NB.split_table(spark, f"{tmp_path}/*"))
        got = {(r["file"].rsplit("/")[-1], r["line"], r["value"]) for r in bad.collect()}
        assert split != "50" or lines.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f, i, x.strip()) for f, body in bodies.items() for i, x in enumerate(body, 1) if x.strip() and not x.startswith("http ")}
