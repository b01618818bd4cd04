import datetime as dt

import pytest
from pyspark.sql import functions as F

from reqlens.functions import exprs as X


def test_parse_interval():
    assert X.parse_interval("10m") == (10, "minute")
    assert X.parse_interval("1min") == (1, "minute")
    assert X.parse_interval("2hours") == (2, "hour")
    assert X.interval_seconds("1d") == 86400
    for bad in ["", "10", "m10", "5x", "2 h"]:
        with pytest.raises(ValueError):
            X.parse_interval(bad)


def test_durations():
    assert X.parse_duration("0.5s", "ms") == 500
    assert X.parse_duration("500ms", "s") == 0.5
    assert X.parse_duration("250", "us") == 250
    assert abs(X.convert_duration(1, "ms", "us") - 1000) < 1e-9


def py_size(n):
    size = float(n)
    for unit in ["B", "KB", "MB", "GB"]:
        if size < 1024.0:
            return f"{size:.1f}{unit}"
        size /= 1024.0
    return f"{size:.1f}TB"


def test_size_label_matches_python(spark):
    vals = [0, 1, 1023, 1024, 1280, 1536, 2047, 1048575, 1048576, 5 * 1024 ** 3 + 1, 3 * 1024 ** 4, 1126, 1177]
    df = spark.createDataFrame([(v,) for v in vals], "b BIGINT")
    got = [r[0] for r in df.select(X.size_label(F.col("b"))).collect()]
    assert got == [py_size(v) for v in vals]


def test_status_class_and_group(spark):
    df = spark.createDataFrame([(s,) for s in [101, 200, 302, 404, 503, None]], "s INT")
    got = df.select(X.status_class(F.col("s")), X.status_group(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("success", "2xx"), ("success", "2xx"), ("redirect", "3xx"), ("client_error", "4xx"),
        ("server_error", "5xx"), ("unknown", "Unknown")]


def test_time_bucket_epoch_aligned_and_null_safe(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 13, 7),), (None,)], "t TIMESTAMP_NTZ")
    got = df.select(X.time_bucket(F.col("t"), "10m"), X.time_bucket(F.col("t"), "7s")).collect()
    assert got[0][0] == dt.datetime(2024, 1, 1, 0, 10)
    assert (got[0][1] - dt.datetime(1970, 1, 1)).total_seconds() % 7 == 0
    assert got[1][0] is None and got[1][1] is None


def test_labels(spark):
    df = spark.createDataFrame([("10.0.0.1", 80), (None, 80), ("10.0.0.2", None)], "ip STRING, port BIGINT")
    got = [r[0] for r in df.select(X.target_key(F.col("ip"), F.col("port"))).collect()]
    assert got == ["10.0.0.1:80", "Unknown", "Unknown"]
