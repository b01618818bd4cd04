"""Line numbers of log lines (S18), however a file is split over tasks.

Spark's text reader hands a task one split of a file and its rows in file order,
so a row's place in its split is the distance of its running id from the
split's first.  A small table (a row per split) holds the lines of each split; its
running sum over a file gives the lines before a split.  Only the rows that
want a number (rejects, usually) are joined with it.  Blank lines count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqlens.sources.text import folder_of, strip_ws

#: columns that stand for a line's place until it is numbered
PLACE = ("__split", "__row")


def _rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    # the id is taken on the scan itself, before any filter or shuffle
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__row"))


def read_numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``read_lines`` with the place of each line: (file, value, ``PLACE``);
    lines are stripped and blank ones left out."""
    return _rows(spark, paths).withColumn("value", strip_ws(F.col("value"))).filter(F.col("value") != "").select("file", "value", *PLACE)


def split_table(spark: SparkSession, paths: str | list[str], by_folder: bool = False) -> DataFrame:
    """(file, __split, first row id, lines of the file before it); with ``by_folder``
    the lines of its folder before it: one log in several files, in the order of their names."""
    per = _rows(spark, paths).groupBy("file", "__split").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    log = folder_of(F.col("file")) if by_folder else F.col("file")
    before = Window.partitionBy(log).orderBy("file", "__split").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", "__split", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def with_line_numbers(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Add ``line`` (from 1) to rows that still have ``PLACE``, and drop it.
    ``splits`` is ``split_table`` of the paths the rows were read from, under the
    same split settings."""
    return (rows.join(splits, ["file", "__split"])
            .withColumn("line", (F.col("__before") + F.col("__row") - F.col("__first") + 1).cast("long"))
            .drop(*PLACE, "__first", "__before"))
