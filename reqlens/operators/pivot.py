"""Flexible pivot (V1–V8): any row field × any column field × an aggregate.

The scalable result is the long form ``(row, col, value)`` — one hash
aggregate over ``(row, col)``.  The wide, zero-filled grid (V8) is Spark's
``pivot`` over an explicit, size-checked list of column values; ``dense_grid``
is the same grid in long form, with no limit on its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.functions.exprs import bucket_of, interval_seconds, status_group
from reqlens.operators.filters import apply_row_filter
from reqlens.operators.quantiles import group_quantiles
from reqlens.operators.stats import quantiles

# Accepted aggregate names.
AGG_FUNCS = ("count", "sum", "avg", "min", "max", "p50", "p90", "p95", "p99", "error_rate")
MAX_PIVOT_COLUMNS = 10000


def pivot_long(df: DataFrame, row: str, col: str, value: str = "count", agg: str = "count",
               interval: str | None = None, status_groups: Sequence[str] | None = None,
               row_filter: str | None = None, top_n: int = 20, status: str = "status",
               exact: bool | str = "sort") -> DataFrame:
    """V1–V7: ``(row, col, value)`` for every (row, col) pair present.

    * ``interval``: the column is a time field, bucketed (V5)
    * ``status_groups``: the column is a status code, grouped 2xx…5xx; only
      the listed groups are kept (V6; an empty list keeps all)
    * ``value='count'`` counts rows; ``'error_rate'`` is the share of rows
      with status ≥ 400 among rows with a status (V4); otherwise ``agg`` of
      the numeric field: count(non-null)/sum/avg/min/max/p50…p99 (V2, V3)
    * ``row_filter``: ``top:N[:agg[:field]]`` or ``threshold:field:op:value`` (V7)
    """
    if agg not in AGG_FUNCS:
        raise ValueError(f"invalid aggregation {agg!r}; one of {AGG_FUNCS}")
    d = df
    if row_filter:
        d = apply_row_filter(d, row, row_filter, top_n, None if value in ("count", "error_rate") else value)
    d = d.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    if interval:
        c = bucket_of(d, col, interval)
    elif status_groups is not None:
        c = status_group(F.col(col))
    else:
        c = F.col(col)
    d = d.select(F.col(row).alias("row"), c.alias("col"), *(
        [F.col(value).try_cast("double").alias("__v")] if value not in ("count", "error_rate") else []),
        *([F.col(status).try_cast("bigint").alias("__s")] if value == "error_rate" else []))
    if status_groups:
        d = d.filter(F.col("col").isin(*status_groups))
    if value == "error_rate":
        v = F.avg((F.col("__s") >= 400).cast("double"))
    elif value == "count":
        v = F.count(F.lit(1))
    else:
        v = {"count": lambda: F.count("__v"), "sum": lambda: F.sum("__v"), "avg": lambda: F.avg("__v"),
             "min": lambda: F.min("__v"), "max": lambda: F.max("__v")}.get(agg, lambda: None)()
        if v is None:
            p = int(agg[1:]) / 100.0
            if exact == "sort":
                return group_quantiles(d, ["row", "col"], "__v", [p], names=["value"])
            v = quantiles(F.col("__v"), [p], exact)[0]
    return d.groupBy("row", "col").agg(v.alias("value"))


def pivot_wide(long: DataFrame, values: Sequence | None = None, fill: float = 0) -> DataFrame:
    """V8: one row per ``row``, one column per ``col`` value, absent cells = ``fill``.

    ``values`` fixes the column set (no extra job); without it the distinct
    column values are fetched first and must not exceed ``MAX_PIVOT_COLUMNS``.
    """
    if values is None:
        vals = [r["col"] for r in long.select("col").distinct().orderBy("col")
                .limit(MAX_PIVOT_COLUMNS + 1).collect()]
        if len(vals) > MAX_PIVOT_COLUMNS:
            raise ValueError(f"more than {MAX_PIVOT_COLUMNS} pivot columns; pass values= explicitly")
    else:
        vals = list(values)
    wide = long.groupBy("row").pivot("col", vals).agg(F.first("value"))
    return wide.na.fill(fill)


def dense_grid(long: DataFrame, interval: str, fill: float = 0) -> DataFrame:
    """V8 in long form, for any number of columns: every row has all buckets
    of its own span, absent cells ``fill``.

    The spine is generated, ``sequence`` over each row's first and last
    bucket, and joined with the cells; nothing is fetched and no list of
    columns exists, so there is no limit on buckets."""
    span = long.groupBy("row").agg(F.min("col").alias("__lo"), F.max("col").alias("__hi"))
    step = F.expr(f"INTERVAL '{interval_seconds(interval)}' SECOND")
    spine = span.select("row", F.explode(F.sequence("__lo", "__hi", step)).alias("col"))
    return spine.join(long, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill).cast(long.schema["value"].dataType)))
