"""Registry of named queries: a Spark plan and (where SQL can say it) the
equivalent DuckDB oracle text, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, TimestampType

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SIG_DIGITS = 10


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def normalized(df: DataFrame, digits: int = SIG_DIGITS) -> DataFrame:
    """Presentation form used for the oracle comparison: doubles rounded to
    ``digits`` significant digits (the oracle rounds the same way — relative,
    so large sums and tiny latencies are treated alike), instants as UTC
    wall-clock ``TIMESTAMP_NTZ``."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(c.isNotNull(), F.format_string(f"%.{digits}g", c.cast("double")).cast("double"))
        elif isinstance(f.dataType, TimestampType):
            # UTC wall clock of the instant, whatever the session time zone
            c = F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, alias: str, digits: int = SIG_DIGITS) -> str:
    """Oracle helper: a double expression rounded like ``normalized``."""
    return f"CAST(printf('%.{digits}g', CAST({expr} AS DOUBLE)) AS DOUBLE) AS {alias}"
