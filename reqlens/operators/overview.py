"""Overview metrics of the single-page edition.

Rows whose time did not parse are excluded from every overview metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.functions.exprs import epoch_micros, interval_seconds
from reqlens.functions.urls import strip_query
from reqlens.operators.series import downsample

OTHER = "Other"


def _valid(df: DataFrame, time: str) -> DataFrame:
    return df.filter(F.col(time).isNotNull())


def totals(df: DataFrame, time: str = "time", status: str = "status", bytes_col: str = "sent_bytes",
           client_ip: str = "client_ip") -> DataFrame:
    """L1: requests, bytes, error % (status text starting 4 or 5), distinct IPs."""
    s = F.col(status).cast("string")
    d = _valid(df, time)
    return d.agg(F.count(F.lit(1)).alias("total_requests"),
                 F.coalesce(F.sum(F.col(bytes_col).try_cast("bigint")), F.lit(0)).cast("bigint").alias("total_bytes"),
                 F.try_divide(F.count_if(s.startswith("4") | s.startswith("5")) * 100.0, F.count(F.lit(1)))
                 .alias("error_rate"),
                 F.count_distinct(F.col(client_ip)).alias("unique_ips"))


def status_donut(df: DataFrame, time: str = "time", status: str = "status", top: int = 5) -> DataFrame:
    """L2: the ``top`` status codes by count, the rest summed as ``Other``."""
    d = _valid(df, time).select(F.coalesce(F.col(status).cast("string"), F.lit("Unknown")).alias("status"))
    counts = d.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
    lead = counts.orderBy(F.desc("count"), "status").limit(top).select("status", F.lit(True).alias("__lead"))
    j = counts.join(lead, "status", "left")
    lab = F.when(F.col("__lead"), F.col("status")).otherwise(F.lit(OTHER))
    return j.groupBy(lab.alias("status")).agg(F.sum("count").cast("bigint").alias("count"))


def top_uris(df: DataFrame, time: str = "time", url: str = "request_url", top: int = 10) -> DataFrame:
    """L3: the ``top`` query-stripped URIs by count (a missing URL counts as '')."""
    u = strip_query(F.coalesce(F.col(url), F.lit("")))
    return (_valid(df, time).groupBy(u.alias("uri")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "uri").limit(top))


def top_ips(df: DataFrame, time: str = "time", client_ip: str = "client_ip", top: int = 50) -> DataFrame:
    """L4: the ``top`` client IPs with their share of all requests (1 decimal).

    The denominator is a scalar subquery over the same per-IP counts (Spark
    reuses that aggregation), so the input is aggregated once.
    """
    d = _valid(df, time)
    per_ip = (d.groupBy(F.coalesce(F.col(client_ip), F.lit("unknown")).alias("ip"))
              .agg(F.count(F.lit(1)).alias("count")))
    total = per_ip.select(F.sum("count")).scalar()
    ips = per_ip.orderBy(F.desc("count"), "ip").limit(top)
    return ips.withColumn("share", F.round(F.col("count") * 100.0 / total, 1))


def per_second_rebucket(df: DataFrame, time: str = "time", interval: str = "10s") -> DataFrame:
    """Counts per epoch second, re-bucketed to ``interval`` (1 s, 10 s, 1 min …).

    Two additive levels: ``(second) → count`` then ``floor(second / width)``.
    """
    width = interval_seconds(interval)
    d = _valid(df, time)
    us = epoch_micros(d, time)
    sec = ((us - F.pmod(us, F.lit(1_000_000))) / 1_000_000).cast("bigint")
    per_sec = d.groupBy(sec.alias("epoch_second")).agg(F.count(F.lit(1)).alias("count"))
    b = (F.col("epoch_second") - F.pmod(F.col("epoch_second"), F.lit(width))).alias("bucket_start")
    return per_sec.groupBy(b).agg(F.sum("count").cast("bigint").alias("count"))


def scatter_sample(df: DataFrame, key: list[str], max_points: int, time: str = "time",
                   rt: str = "target_processing_time", seed: int = 42) -> DataFrame:
    """Up to ``max_points`` rows with a positive response time."""
    d = _valid(df, time).filter(F.col(rt) > 0)
    return downsample(d, key, max_points, seed)
