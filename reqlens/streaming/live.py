"""Request counts per time window while log files keep arriving.

Structured Streaming over a folder of text files: each micro-batch is parsed
with the same native expressions as the batch path, counted per window and
landed as Parquet under its number.  There is no state: readers add the batches
up, so a row counts however late it comes.

So that readers do not list a folder per batch for ever, old batches are merged
(``compact_window_counts``): their sum is written as a new version, a manifest
naming it is written after it, and what the manifest before the last one
stood for is deleted.  A reader sees one manifest or the next, never half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions.exprs import spark_interval
from reqlens.session import shared_dir
from reqlens.sources.formats import LogFormat
from reqlens.sources.text import parse_lines, strip_ws


def stream_lines(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)
    return raw.select(strip_ws(F.col("value")).alias("value")).filter(F.col("value") != "")


def live_window_counts(spark: SparkSession, source_dir: str, fmt: LogFormat, time: str = "time",
                       window: str = "1s", out_dir: str | None = None,
                       checkpoint_dir: str | None = None, available_now: bool = True,
                       max_files_per_trigger: int | None = None, compact_every: int | None = 100):
    """Start the stream; returns ``(query, out_dir)``.

    With ``available_now`` the query processes what is in ``source_dir`` and
    stops; otherwise it keeps running on new files.  Every micro-batch counts
    its own rows and lands them under its number (a repeated batch overwrites
    itself); readers add the batches up.  There is no state and no watermark,
    so a row counts however late it comes and however batches are cut.
    Every ``compact_every`` batches the older ones are merged.
    """
    out_dir = out_dir or shared_dir(spark, "live-counts")
    checkpoint_dir = checkpoint_dir or shared_dir(spark, "live-checkpoint")
    parsed = parse_lines(stream_lines(spark, source_dir, max_files_per_trigger), fmt, columns=[time],
                         keep=[]).records
    def land(batch: DataFrame, batch_id: int) -> None:
        counts = (batch.filter(F.col(time).isNotNull())
                  .groupBy(F.window(F.col(time), spark_interval(window)).alias("w"))
                  .agg(F.count(F.lit(1)).alias("count"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count"))
        counts.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_window_counts(spark, out_dir)

    w = parsed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(), out_dir


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers ``n`` of the finished folders ``<prefix><n>`` under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [p for p in found if p.getName().startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[len(prefix):]) for p in done)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _manifest(spark: SparkSession, out_dir: str, version: int) -> int:
    """The last batch that a version holds."""
    return int(spark.read.text(f"{out_dir}/_manifest/v={version}").first()["value"])


def _sum(df: DataFrame) -> DataFrame:
    return df.groupBy("window_start", "window_end").agg(F.sum("count").alias("count"))


def compact_window_counts(spark: SparkSession, out_dir: str, hold: int = 1) -> int | None:
    """Merge all landed batches but the ``hold`` newest (a repeated batch may
    still overwrite itself) into a new version; returns its number, or None
    where there is nothing to merge.  One writer at a time, as batches are."""
    versions = _children(spark, f"{out_dir}/_manifest", "v=")
    batches = _children(spark, out_dir, "batch=")
    held = _manifest(spark, out_dir, versions[-1]) if versions else -1
    new = [b for b in batches if b > held]
    new = new[:len(new) - hold] if hold else new
    if not new:
        return None
    version = versions[-1] + 1 if versions else 0
    parts = spark.read.parquet(*(f"{out_dir}/batch={b}" for b in new))
    if versions:
        parts = parts.unionByName(spark.read.parquet(f"{out_dir}/_compact/v={versions[-1]}"))
    _sum(parts).write.mode("overwrite").parquet(f"{out_dir}/_compact/v={version}")
    (spark.createDataFrame([(str(new[-1]),)], "value STRING").coalesce(1)
     .write.mode("overwrite").text(f"{out_dir}/_manifest/v={version}"))
    # a reader may still hold the manifest before this one: what is older than that goes
    for old in versions[:-1]:
        _delete(spark, f"{out_dir}/_manifest/v={old}")
        _delete(spark, f"{out_dir}/_compact/v={old}")
    for b in batches:
        if b <= held:
            _delete(spark, f"{out_dir}/batch={b}")
    return version


def read_window_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Counts per window: the last merged version and the batches after it."""
    versions = _children(spark, f"{out_dir}/_manifest", "v=")
    if not versions:
        return _sum(spark.read.parquet(out_dir))
    held = _manifest(spark, out_dir, versions[-1])
    parts = spark.read.parquet(f"{out_dir}/_compact/v={versions[-1]}")
    after = [b for b in _children(spark, out_dir, "batch=") if b > held]
    if after:
        parts = parts.unionByName(spark.read.parquet(*(f"{out_dir}/batch={b}" for b in after)))
    return _sum(parts)
