import json

from reqlens.operators import stats
from reqlens.session import shared_dir
from reqlens.sinks import writers as W
from reqlens.sources import formats as FM
from reqlens.streaming import live
from reqlens.streaming.live import live_window_counts, read_window_counts

LINES = [
    '10.0.0.1 - - [01/Jan/2024:00:00:01 +0000] "GET /a HTTP/1.1" 200 10',
    '10.0.0.2 - - [01/Jan/2024:00:00:01 +0000] "GET /b HTTP/1.1" 200 10',
    '10.0.0.3 - - [01/Jan/2024:00:00:02 +0000] "GET /c HTTP/1.1" 500 10',
    "junk line",
]


def test_json_csv_parquet_table_roundtrips(spark):
    df = spark.createDataFrame([(1, "/a", 0.5), (2, "/b", None)], "id BIGINT, url STRING, rt DOUBLE")
    p = W.write_json_lines(df, shared_dir(spark, "t-json"))
    assert sorted(tuple(r) for r in W.read_json_lines(spark, p, "id BIGINT, url STRING, rt DOUBLE").collect()) \
        == [(1, "/a", 0.5), (2, "/b", None)]
    p = W.write_csv(df, shared_dir(spark, "t-csv"), sep="|")
    assert W.read_csv(spark, p, "id BIGINT, url STRING, rt DOUBLE", sep="|").count() == 2
    p = W.save_snapshot(df, shared_dir(spark, "t-pq"))
    assert W.load_snapshot(spark, p).count() == 2
    W.save_table(df, "reqlens_t_table", shared_dir(spark, "t-tab"))
    assert W.load_table(spark, "reqlens_t_table").count() == 2
    secs = W.write_sections(stats.calculate_stats(df.withColumnRenamed("url", "request_url")
                                                  .withColumnRenamed("rt", "target_processing_time"), ["url"]),
                            shared_dir(spark, "t-secs"))
    assert set(secs) == {"url_stats"}


def test_rule_document_forms(spark):
    for doc, n in [({"patternRules": [{"pattern": "^/a$", "replacement": "/a"}]}, 1),
                   ({"patterns": ["/x/*", "/y.z"]}, 2), ({"urls": ["/u"]}, 1)]:
        d = shared_dir(spark, "t-doc")
        spark.createDataFrame([(json.dumps(doc),)], "value STRING").write.text(d)
        got = W.read_rule_document(spark, d).orderBy("ord").collect()
        assert len(got) == n
        if "patterns" in doc:
            assert got[0]["pattern"] == "^/x/.*$" and got[1]["pattern"] == r"^/y\.z$"


def test_streaming_window_counts(spark):
    src = shared_dir(spark, "t-live-src")
    spark.createDataFrame([(x,) for x in LINES], "value STRING").write.text(src)
    q, out = live_window_counts(spark, src, FM.preset("httpd"), window="1s")
    q.awaitTermination()
    got = sorted(r["count"] for r in read_window_counts(spark, out).collect())
    assert got == [1, 2]


def test_streaming_counts_late_rows(spark):
    """One file per micro-batch, the last one days behind: nothing is lost."""
    src = shared_dir(spark, "t-live-late")
    late = LINES[0].replace("/Aug/", "/Jan/") if "/Aug/" in LINES[0] else LINES[0]
    for i, part in enumerate([LINES[:1], LINES[1:2], [late]]):
        spark.createDataFrame([(x,) for x in part], "value STRING").coalesce(1).write.text(f"{src}/f{i}")
    q, out = live_window_counts(spark, f"{src}/*", FM.preset("httpd"), window="1s", max_files_per_trigger=1)
    q.awaitTermination()
    assert sum(r["count"] for r in read_window_counts(spark, out).collect()) == 3


def test_streaming_count_across_batches(spark):
    """Two files, one per micro-batch, hitting the same window: the counts of
    both batches add up."""
    src = shared_dir(spark, "t-live-multi")
    for i, part in enumerate([LINES[:1], LINES[1:2]]):
        spark.createDataFrame([(x,) for x in part], "value STRING").coalesce(1).write.text(f"{src}/f{i}")
    q, out = live_window_counts(spark, f"{src}/*", FM.preset("httpd"), window="1s",
                                max_files_per_trigger=1)
    q.awaitTermination()
    landed = spark.read.parquet(out)
    assert landed.select("batch").distinct().count() == 2
    assert [r["count"] for r in read_window_counts(spark, out).collect()] == [2]


def test_hundred_batches_are_compacted(spark):
    """Merged every ten batches, 100 batches leave few folders; every reading
    between equals the sum of all rows landed so far."""
    from pyspark.sql import functions as F
    out, total = shared_dir(spark, "t-live-compact"), 0
    all_rows = spark.range(100).select(
        F.col("id").alias("batch"), F.timestamp_seconds(F.col("id") % 7).alias("window_start"),
        F.timestamp_seconds(F.col("id") % 7 + 1).alias("window_end"), (F.col("id") + 1).alias("count"))
    staged = shared_dir(spark, "t-live-staged")
    all_rows.write.partitionBy("batch").parquet(staged)
    rows = spark.read.parquet(staged).cache()
    for tens in range(10):
        for b in range(10 * tens, 10 * tens + 10):
            if b in (0, 9, 95, 99) or b % 10 == 5:          # batches without rows are folders too
                rows.where(F.col("batch") == b).drop("batch").coalesce(1).write.parquet(f"{out}/batch={b}")
                total += b + 1
        live.compact_window_counts(spark, out)
        assert read_window_counts(spark, out).agg(F.sum("count")).first()[0] == total
    assert len(live._children(spark, out, "batch=")) <= 4 and len(live._children(spark, f"{out}/_manifest", "v=")) <= 2
    # a repeated newest batch overwrites itself and is not counted twice
    rows.where("batch = 99").drop("batch").write.mode("overwrite").parquet(f"{out}/batch=99")
    assert read_window_counts(spark, out).agg(F.sum("count")).first()[0] == total


def test_stream_compacts_as_it_runs(spark):
    src = shared_dir(spark, "t-live-run")
    for i in range(6):
        spark.createDataFrame([(x,) for x in LINES[i % 3:i % 3 + 1]], "value STRING").coalesce(1).write.text(f"{src}/f{i}")
    q, out = live_window_counts(spark, f"{src}/*", FM.preset("httpd"), max_files_per_trigger=1, compact_every=2)
    q.awaitTermination()
    assert live._children(spark, f"{out}/_manifest", "v=")
    assert sorted(r["count"] for r in read_window_counts(spark, out).collect()) == [2, 4]


def test_dense_grid_has_every_bucket(spark):
    """20,000 ten-second buckets between two cells."""
    from reqlens.operators.pivot import dense_grid
    long = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 00:00:00', 5L), ('a', TIMESTAMP_NTZ '2024-01-03 07:33:10', 7L), "
                     "('b', TIMESTAMP_NTZ '2024-01-01 00:00:00', 1L) AS t(row, col, value)")
    got = dense_grid(long, "10s").groupBy("row").agg({"value": "sum", "*": "count"}).collect()
    assert sorted(tuple(r) for r in got) in ([("a", 12, 20_000), ("b", 1, 1)], [("a", 20_000, 12), ("b", 1, 1)])
