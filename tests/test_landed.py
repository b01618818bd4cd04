"""Queries over landed text: whole jobs, work dealt over tasks whatever the row groups of the tables."""

import datetime as dt
import glob

import pytest

from pyspark.sql import functions as F

from reqlens.plans import QUERIES
from reqlens.plans import q_mixed as QM
from reqlens.plans import q_sources as QS
from reqlens.session import shared_dir
from reqlens.sources import fixtures as FX
from reqlens.sources import text as TX
from reqlens.sources.formats import PRESETS

N = 700


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    t0 = dt.datetime(2024, 1, 1)
    # one error in the whole table: no small sample of it has all status classes
    events = [(i, t0 + dt.timedelta(seconds=i), i, "error" if i == 500 else "view", 1.5 + i, '{"k": %d}' % (i % 9)) for i in range(N)]
    spark.createDataFrame(events, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING") \
        .coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, f"https://e.com/p{i}") for i in range(7)], "page_id BIGINT, url STRING").coalesce(1).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, f"note {i}\r\nmore of {i}\n\n2024 x") for i in range(50)], "doc_id BIGINT, text STRING") \
        .coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def test_scatter_counters_count_every_point(spark, tables):
    plotted = [i for i in range(N) if i % 101]
    got = QUERIES["t13_scatter_counters"](spark, tables).first()
    # success, redirect, server_error, unknown
    assert tuple(got) == (N, len(plotted), 4, 0)


def _tasks(df):
    return df.rdd.getNumPartitions()


def test_rendering_is_dealt_by_rows(spark, tables, monkeypatch):
    """One row group of events, one of documents: as many tasks as their rows ask for."""
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 100)
    monkeypatch.setattr(FX, "DOCUMENTS_A_TASK", 10)
    lines = FX.log_lines(spark, tables, "json")
    assert _tasks(lines) == 7 + 5 and lines.count() == N + 50 * 4
    got = {r["line_set"]: r["n_lines"] for r in QUERIES["s1_s2_read_lines"](spark, tables).collect()}
    assert got == dict.fromkeys(FX.LINE_FORMATS, N + 50 * 3)


def test_line_types_of_many_files(spark, tables, monkeypatch):
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 100)
    monkeypatch.setattr(QS, "_LANDED", {})
    got = {(r["line_set"], r["line_type"]): r["n"] for r in QUERIES["l7_line_types"](spark, tables).collect()}
    assert got[("json", "JSON")] == N and got[("alb", "ALB")] == N and got[("grok", "UNKNOWN")] == N + 150
    assert len(glob.glob(f"{QS._LANDED[(spark.sparkContext.applicationId, tables, 'alb', True)]}/*.gz")) >= 7


@pytest.mark.parametrize("name, total", [("s21_s23_resolved_fields", "n"), ("s24_feature_availability", "n_records")])
def test_parses_of_many_files(spark, tables, monkeypatch, name, total):
    """The parse of a line set has the tasks that its files allow, and loses no line."""
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 100)
    monkeypatch.setattr(QS, "_LANDED", {})
    rows = QUERIES[name](spark, tables).where("line_set = 'alb'").select(total, *(["feature"] if total == "n_records" else [])).collect()
    assert {r[total] for r in rows} == {N} if total == "n_records" else sum(r[total] for r in rows) == N
    assert len(glob.glob(f"{QS._LANDED[(spark.sparkContext.applicationId, tables, 'nginx', True)]}/*.gz")) >= 7


def test_a_line_that_cannot_be_json_is_not_parsed(spark):
    texts = ['{"a": 1}', "[1]", '"x"', "12", "-1.5e3", "0", "true", "null", "10.0.0.1 - - [x]", "2024-01-01", "007", "nothing", "{x", "-", "+1",
             "2024 x", "1.", "1.5 tail", '{"a": 1} tail', "falsey", "false", "1e", "NaN", "1\tx", "1 x"]
    df = spark.createDataFrame([(x,) for x in texts], "value STRING")
    got = df.select("value", TX.json_text(F.col("value")).alias("now"), F.try_parse_json("value").isNotNull().alias("was")).collect()
    assert [r["value"] for r in got if r["now"] != r["was"]] == []
    parsed = df.where(F.col("value").rlike(TX.JSON_START))
    assert {"10.0.0.1 - - [x]", "2024-01-01", "nothing", "007"}.isdisjoint(r["value"] for r in parsed.collect())
    plan = TX.format_success_rates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "|true|false|null)" in plan


def test_no_task_holds_a_whole_log(spark, tables, monkeypatch):
    """Logs of the mixed folder are several files each, and still one row a log."""
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 100)
    lines = QM._mixed_folder(spark, tables)
    written = spark.read.text(lines.inputFiles()).select(F.col("_metadata.file_path").alias("f")).distinct()
    assert written.where("f LIKE '%/alb/part=0/%'").count() == 7
    got = {(r["line_set"], r["part"]): (r["log_type"], r["n"]) for r in QUERIES["s20_file_formats"](spark, tables).collect()}
    assert len(got) == 21 and got[("alb", 0)] == ("ALB", 234) and got[("nginx", 1)] == ("APACHE", 233) and got[("json", 2)] == ("JSON", 233)


def test_records_and_rejects_of_a_mixed_folder_in_one_pass(spark, tables, monkeypatch):
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 100)
    df = QUERIES["s2_s19_mixed_folder"](spark, tables)
    rows = df.collect()
    assert len(rows) == 21 and sum(r["n_records"] + r["n_rejected"] for r in rows) == 6 * N + 50 * 3
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") <= 2


def test_line_numbers_run_over_the_files_of_a_log(spark, tables, monkeypatch):
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 50)
    made = []
    monkeypatch.setattr(QM, "shared_dir", lambda s, name: made.append(shared_dir(s, name)) or made[-1])
    got = {(r["part"], r["line"], r["value"]) for r in QUERIES["s18c_rejected_line_numbers"](spark, tables).collect()}
    assert got == {(i % 4, i // 4 + 1, f"# note {i}") for i in range(N) if i % 10 == 3 and i % 25 != 7}
    assert len(glob.glob(f"{made[0]}/part=1/part-*")) > 1


def test_apache_hint_has_the_same_truth(spark, tables):
    texts = [a + b + c + d for a in ("1.2.3.4", "10.20.30.400", "1.2.3.", "x 1.2.3.4 y", "1.2.3.4.5") for b in (" [t] ", " ] [", "[]", " [a] [b")
             for c in ('"GET /a" ', '"get" "P" ', '"A', '"x" "POST u" "Q" ', '"" ') for d in ("200", "20", "1 22 333", "x")]
    lines = FX.render_lines(FX.requests_relation(spark, tables), "httpd").union(spark.createDataFrame([(x,) for x in texts], "value STRING"))
    both = lines.select(F.col("value").rlike(TX.APACHE_HINT).alias("a"), TX.line_scores(F.col("value"))[2].alias("b")).groupBy("a", "b").count().collect()
    assert {(r["a"], r["b"]) for r in both} == {(True, True), (False, False)}


def test_junk_is_landed_once_for_all_line_sets(spark, tables, monkeypatch):
    monkeypatch.setattr(QS, "_LANDED", {})
    got = QUERIES["l7_line_types"](spark, tables).groupBy("line_set").sum("n").collect()
    assert {r[0]: r[1] for r in got} == dict.fromkeys(FX.LINE_FORMATS, N + 50 * 3)
    landed = {key[2]: spark.read.text(path).count() for key, path in QS._LANDED.items()}
    assert landed == dict.fromkeys(FX.LINE_FORMATS, N) | {"junk": 50 * 4}


@pytest.mark.parametrize("name, column", [("alb", "elb_status_code"), ("httpd", "status")])
def test_columns_that_nobody_reads_are_not_made(spark, tables, name, column):
    """A parse of all columns of which one is read: the others' expressions are gone from the plan."""
    lines = FX.log_lines(spark, tables, name)
    records = TX.parse_lines(lines, PRESETS[name]).records
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    used = lambda df: plan(df).count("element_at")
    assert used(records.select(column)) < used(records) / 2
    assert records.groupBy().count().first()[0] == records.select(column).count() == records.count()
