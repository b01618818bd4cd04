"""Statistics checked against pandas on a 100-row table (5 URLs, 2 IPs,
1-minute steps: 80 × 200, 10 × 404, 10 × 500), like the reference's fixture."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from reqlens.operators import stats


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    status = [200] * 80 + [404] * 10 + [500] * 10
    rng.shuffle(status)
    pdf = pd.DataFrame({
        "time": [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i) for i in range(100)],
        "request_url": [f"/api/r{i % 5}" for i in range(100)],
        "elb_status_code": status,
        "client_ip": [f"10.0.0.{i % 2}" for i in range(100)],
        "target_processing_time": np.round(rng.uniform(0.01, 2.0, 100), 3),
        "request_processing_time": np.round(rng.uniform(0.0, 0.01, 100), 4),
    })
    df = spark.createDataFrame(pdf, "time TIMESTAMP_NTZ, request_url STRING, elb_status_code INT, "
                                    "client_ip STRING, target_processing_time DOUBLE, "
                                    "request_processing_time DOUBLE")
    return pdf, df


def test_url_stats_match_pandas(table):
    pdf, df = table
    out = {r["url"]: r for r in stats.url_stats(df, status="elb_status_code",
                                                processing_fields=["request_processing_time"]).collect()}
    for url, g in pdf.groupby("request_url"):
        r = out[url]
        s = g["target_processing_time"]
        assert r["count"] == len(g)
        assert r["response_time_avg"] == pytest.approx(s.mean())
        assert r["response_time_median"] == pytest.approx(s.median())
        assert r["response_time_std"] == pytest.approx(s.std())
        for q in (90, 95, 99):
            assert r[f"response_time_p{q}"] == pytest.approx(s.quantile(q / 100))
        assert r["request_processing_time_p95"] == pytest.approx(g["request_processing_time"].quantile(0.95))


def test_url_stats_sort_and_top(table):
    pdf, df = table
    top = stats.url_stats(df, sort_by="target_processing_time", sort_metric="sum", top_n=2).collect()
    want = pdf.groupby("request_url")["target_processing_time"].sum().sort_values(ascending=False)
    assert [r["url"] for r in top] == list(want.index[:2])


def test_summary_and_status(table):
    pdf, df = table
    s = stats.summary_stats(df).first()
    assert s["total_requests"] == 100 and s["unique_urls"] == 5 and s["unique_ips"] == 2
    assert s["response_time_p10"] == pytest.approx(pdf["target_processing_time"].quantile(0.1))
    dist = {r["elb_status_code"]: r["count"] for r in stats.status_distribution(df, "elb_status_code").collect()}
    assert dist == {200: 80, 404: 10, 500: 10}


def test_time_stats(table):
    pdf, df = table
    out = stats.time_stats(df, status="elb_status_code", interval="10m").collect()
    assert len(out) == 10 and [r["time_bucket"] for r in out] == sorted(r["time_bucket"] for r in out)
    first = pdf.iloc[:10]
    assert out[0]["error_count"] == int((first["elb_status_code"] >= 400).sum())
    assert out[0]["p95_response_time"] == pytest.approx(first["target_processing_time"].quantile(0.95))


def test_ip_stats_and_minutes(table):
    _, df = table
    ips = stats.ip_stats(df, status="elb_status_code").collect()
    assert [r["ip"] for r in ips] == ["10.0.0.0", "10.0.0.1"] and ips[0]["count"] == 50
    m = stats.minute_table(df, status="elb_status_code").collect()
    assert len(m) == 100 and sum(r["error_count"] for r in m) == 20
    assert sum(r["status_2xx"] for r in m) == 80
    d = stats.dashboard_minutes(df, status="elb_status_code", rt_unit="s").first()
    assert d["avg_response_time_ms"] == pytest.approx(
        table[0].iloc[0]["target_processing_time"] * 1000)


def test_patterns_and_calculate_stats(table):
    _, df = table
    pats = stats.uri_patterns(df).collect()
    assert [(r["pattern"], r["count"]) for r in pats] == [
        ("/api/r0", 20), ("/api/r1", 20), ("/api/r2", 20), ("/api/r3", 20), ("/api/r4", 20)]
    secs = stats.calculate_stats(df, ["all"], status="elb_status_code")
    assert set(secs) >= {"summary", "url_stats", "time_stats", "ip_stats"}
    assert secs["url_stats"].count() == 5
    approx = stats.url_stats(df, exact=False).first()
    assert approx["response_time_p95"] is not None


def test_sorted_quantiles_match_pandas_with_hot_group(spark):
    from reqlens.operators.quantiles import group_quantiles
    rng = np.random.default_rng(3)
    n = 5000
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))     # one key holds half
    v = np.round(rng.exponential(1.0, n), 2)
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}),
                     pd.DataFrame({"g": ["solo", "duo", "duo"], "v": [5.0, 1.0, 2.0]})])
    probs = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = group_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas()
    got = got.set_index("g").sort_index()
    want = pdf.groupby("g")["v"].quantile(probs).unstack().sort_index()
    assert np.allclose(got.values, want.values, rtol=0, atol=1e-12)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_quantiles_do_not_depend_on_exchange_reuse(spark, sf, reuse):
    from pyspark.sql import functions as F
    from reqlens.operators.quantiles import group_quantiles
    from reqlens.sources.fixtures import lineitem_requests
    df = lineitem_requests(spark, sf)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = group_quantiles(df, ["status"], "target_processing_time", [0.5, 0.95]).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = df.groupBy("status").agg(F.percentile("target_processing_time", [0.5, 0.95]).alias("q")).collect()
    assert {r["status"]: pytest.approx([r["q0"], r["q1"]]) for r in got} == {r["status"]: r["q"] for r in want}


def test_missing_and_dirty_fields(spark):
    rows = [("2024-01-01 00:00:00", "/a", "200", "0.5"), ("2024-01-01 00:00:01", "/a", "oops", "-"), (None, "/b", "500", "1.5")]
    df = spark.createDataFrame(rows, "time STRING, request_url STRING, status STRING, rt STRING").selectExpr(
        "cast(time as timestamp_ntz) time", "request_url", "status", "rt")
    secs = stats.calculate_stats(df, ["all"], rt="rt")
    assert set(secs) == {"summary", "status_distribution", "url_stats", "time_stats"}       # no client column
    assert secs["summary"].first()["response_time_avg"] == 1.0
    assert {r["url"]: r["response_time_max"] for r in secs["url_stats"].collect()} == {"/a": 0.5, "/b": 1.5}
    assert secs["time_stats"].first()["error_count"] == 0
    bare = stats.calculate_stats(df, ["all"], rt=None)
    assert bare["url_stats"].columns == ["url", "count"] and bare["summary"].first()["total_requests"] == 3


def test_sort_mode_equals_buffer_mode(table):
    _, df = table
    a = {r["url"]: r.asDict() for r in stats.url_stats(df, processing_fields=["request_processing_time"], exact=True).collect()}
    b = {r["url"]: r.asDict() for r in stats.url_stats(df, processing_fields=["request_processing_time"],
                                                       exact="sort").collect()}
    for url in a:
        for k, x in a[url].items():
            assert b[url][k] == pytest.approx(x), (url, k)
    s1, s2 = stats.summary_stats(df, exact=True).first(), stats.summary_stats(df).first()
    assert s1.asDict() == pytest.approx(s2.asDict())


def test_calculate_stats_snapshot(table):
    _, df = table
    secs = stats.calculate_stats(df, ["summary", "ip"], status="elb_status_code", materialize="snapshot")
    assert secs["summary"].first()["total_requests"] == 100
    assert secs["ip_stats"].count() == 2


# --------------------------------------------------------------- quantiles
PROBS = [0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]


def _equal_percentile(df):
    """group_quantiles equals Spark's percentile."""
    from pyspark.sql import functions as F
    from reqlens.operators.quantiles import group_quantiles
    got = {r["g"]: list(r)[1:] for r in group_quantiles(df, ["g"], "v", PROBS).collect()}
    want = {r["g"]: r["q"] for r in df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.percentile("v", PROBS).alias("q")).collect()}
    assert set(got) == set(want)
    for g in want:
        assert all(a == b or (a != a and b != b) or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got[g], want[g])), (g, got[g], want[g])


def _shapes(spark):
    """Ranges of every kind: one hot key of distinct epoch seconds, a narrow
    band, clusters far apart, ties, infinities, tiny groups."""
    from pyspark.sql import functions as F
    i = F.col("id")
    v = {"epochs": 1.7e9 + (i * 7919) % 100003, "band": 20000 + (i % 50000) / 250, "far": F.exp((i % 1400) - 700.0),
         "ties": F.pmod(i, F.lit(3)) * 1.0, "skew": F.when(i % 1000 == 0, i * 1e6).otherwise(i % 17 / 16),
         "edges": F.when(i % 3 == 0, F.lit(float("inf"))).when(i % 3 == 1, F.lit(float("-inf"))).otherwise(i * 1.0)}
    out = None
    for g, x in v.items():
        part = spark.range(100003).select(F.lit(g).alias("g"), x.cast("double").alias("v"))
        out = part if out is None else out.union(part)
    few = [("one", 5.0), ("two", 1.0), ("two", 2.0), ("inf", float("inf")), ("inf", float("inf")), ("pair", float("-inf")), ("pair", 4.0),
           ("gone", None), ("gone", float("nan")), ("some", None), ("some", 3.0), (None, 1.0)]
    return out.union(spark.createDataFrame(few, "g string, v double")).where("g IS NOT NULL")


def test_quantiles_equal_percentile_for_any_range(spark):
    _equal_percentile(_shapes(spark))


def test_large_groups_are_split_again(spark, monkeypatch):
    """Groups beyond LARGE count parts of their intervals first; the part of a
    wanted rank is split into its values."""
    from reqlens.operators import quantiles
    for name, value in (("LARGE", 500), ("PARTS", 4), ("ACCURACY", 50)):
        monkeypatch.setattr(quantiles, name, value)
    _equal_percentile(_shapes(spark))


def test_a_task_holds_a_small_share_of_a_hot_group(spark):
    """200,000 distinct epoch seconds in one key make few cells, spread by value."""
    from pyspark.sql import functions as F
    from reqlens.operators import quantiles as Q
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.col("id") + 1_700_000_000).cast("double").alias("v"))
    bounds = df.groupBy("g").agg(*Q.rank_bounds([("v", "v")], [0.5, 0.95])).first()
    low, high = bounds["__b_v"][:2], bounds["__b_v"][2:]
    assert all(a <= 1_700_000_000 + p * 199_999 <= b for a, b, p in zip(low, high, (0.5, 0.95)))
    assert sum(b - a + 1 for a, b in zip(low, high)) < 0.02 * 200_000


def test_number_text_and_empty_input(spark):
    from reqlens.operators.quantiles import group_quantiles
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "2.5"), ("b", "-")], "g string, v string")
    assert [tuple(r) for r in group_quantiles(df, ["g"], "v", [0.5]).collect()] == [("a", 1.75)]
    assert group_quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []
    assert group_quantiles(df, [], "v", [1.0, 0.0], names=["hi", "lo"]).first().asDict() == {"hi": 2.5, "lo": 1.0}
