import datetime as dt

import pytest

from pyspark.sql import functions as F

from reqlens.functions.urls import Rule
from reqlens.operators import pivot as V
from reqlens.operators import rules as R
from reqlens.operators import series as S


def _df(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = []
    # /a/1 .. : 6 rows of /a/*, 4 of /b/*, 2 of /c, 1 of /d, 1 null URL
    for i, u in enumerate(["/a/1"] * 3 + ["/a/2"] * 3 + ["/b/7"] * 4 + ["/c"] * 2 + ["/d"] + [None]):
        data.append((i, t0 + dt.timedelta(seconds=5 * i), u, 100 + i, 0.1 * (i + 1), 200 if i % 4 else 500))
    return spark.createDataFrame(data, "event_id INT, time TIMESTAMP_NTZ, request_url STRING, "
                                       "received_bytes BIGINT, target_processing_time DOUBLE, status INT")


def _tot(df, value="count"):
    return {r["label"]: r["t"] for r in df.groupBy("label").agg(F.sum(value).alias("t")).collect()}


def test_top_n_with_others_and_unknown(spark):
    out = S.requests_per_uri(_df(spark), interval="1min", top_n=2)
    assert _tot(out) == {"/a/*": 6, "/b/*": 4, "Others": 3, "Unknown": 1}


def test_rules_as_leaders(spark):
    rules = [Rule(r"/c.*", "/c-page"), Rule(r"/d", "/d")]
    out = S.requests_per_uri(_df(spark), interval="1h", rules=rules)
    assert _tot(out) == {"/c-page": 2, "/d": 1, "Others": 10, "Unknown": 1}


def test_bytes_cells_and_ranking(spark):
    cells, rank = S.bytes_per_uri(_df(spark), "received_bytes", interval="1h", top_n=2)
    assert set(_tot(cells, "sum_bytes")) == {"/a/*", "/b/*"}
    r = {x["label"]: x for x in rank.collect()}
    assert r["/a/*"]["rank_sum"] == 1 and r["/b/*"]["total_sum"] == sum(100 + i for i in range(6, 10))
    assert r["/b/*"]["rank_avg"] == 1          # mean of bucket means: 107.5 vs 102.5


def test_processing_time_others_recomputed(spark):
    out = S.processing_time_per_uri(_df(spark), metric="max", interval="1h", top_n=1)
    got = {r["label"]: r["value"] for r in out.collect()}
    assert got["Others"] == pytest.approx(1.3) and got["Unknown"] == pytest.approx(1.4)


def test_display_ranking_others_last(spark):
    t1 = S.requests_per_uri(_df(spark), interval="1min", top_n=2)
    rk = S.display_ranking(t1, "count", top_n=2).orderBy("display_rank").collect()
    assert [r["label"] for r in rk] == ["/a/*", "/b/*", "Others"]


def test_scatter_and_downsample(spark):
    df = _df(spark)
    pts = S.scatter_points(df, keep=["event_id"])
    assert pts.count() == 14 and {r["group"] for r in pts.collect()} == {"success", "server_error"}
    ips = S.scatter_points(df, group_by="ip", target_ip="request_url")
    assert ips.count() == 13
    sample = S.downsample(pts, ["event_id"], max_points=5)
    ids = [r["event_id"] for r in sample.collect()]
    assert len(ids) == 5 and ids == [r["event_id"] for r in S.downsample(pts, ["event_id"], 5).collect()]
    c = S.scatter_counters(df, sample).first()
    assert (c["original_rows"], c["plotted_rows"]) == (14, 5)


def test_rule_store_merge(spark):
    old = spark.createDataFrame([(0, "^/a$", "/a"), (1, "^/x$", "")], R.RULE_SCHEMA)
    new = spark.createDataFrame([(0, "^/b$", "/b"), (1, "^/a2$", "/a")], R.RULE_SCHEMA)
    got = [tuple(r) for r in R.merge_rules(old, new).orderBy("ord").collect()]
    assert got == [(0, "^/a$", "/a"), (1, "^/b$", "/b")]


def test_pivot_long_and_wide(spark):
    df = _df(spark)
    long = V.pivot_long(df, "request_url", "status", status_groups=["2xx", "5xx"])
    got = {(r["row"], r["col"]): r["value"] for r in long.collect()}
    assert got[("/a/1", "5xx")] == 1 and got[("/a/1", "2xx")] == 2
    wide = {r["row"]: r for r in V.pivot_wide(long, values=["2xx", "5xx"]).collect()}
    assert (wide["/c"]["2xx"], wide["/c"]["5xx"]) == (2, 0)      # absent cell filled with 0
    assert (wide["/d"]["2xx"], wide["/d"]["5xx"]) == (0, 1)
    er = V.pivot_long(df, "request_url", "time", value="error_rate", interval="1h").collect()
    er = {r["row"]: r["value"] for r in er}
    assert er["/c"] == 0.0 and er["/d"] == 1.0 and er["/a/1"] == pytest.approx(1 / 3)
    p = V.pivot_long(df, "request_url", "time", value="target_processing_time", agg="p50", interval="1h",
                     row_filter="top:1:count").collect()
    assert len(p) == 1 and p[0]["row"] == "/b/7"


def test_scatter_sample_has_no_cut_of_its_own():
    from inspect import Parameter, signature

    from reqlens.operators.overview import scatter_sample
    assert signature(scatter_sample).parameters["max_points"].default is Parameter.empty
