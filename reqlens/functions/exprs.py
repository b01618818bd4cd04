"""Scalar expressions: status classes, time buckets, units, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.functions.urls import UNKNOWN

# ---------------------------------------------------------------------------
# Interval units and their accepted spellings ('m' means minutes
# in access logs), with their length in seconds.
# ---------------------------------------------------------------------------
INTERVAL_UNITS = {
    "second": (1, "s sec secs second seconds"),
    "minute": (60, "m min minute minutes"),
    "hour": (3600, "h hr hrs hour hours"),
    "day": (86400, "d day days"),
}
# Duration units as powers of ten of one second.
UNIT_EXPONENT = {"s": 0, "ms": -3, "us": -6, "ns": -9}
SECONDS_PER_UNIT = {u: 10.0 ** e for u, e in UNIT_EXPONENT.items()}
_SPELLING = {name: unit for unit, (_, names) in INTERVAL_UNITS.items() for name in names.split()}


def split_quantity(text: str) -> tuple[str, str]:
    """``'10m'`` → ``('10', 'm')``: the leading run of digits and points, and
    the lower-cased rest; blanks around both are dropped."""
    text = text.strip()
    cut = next((i for i, ch in enumerate(text) if not (ch.isdecimal() or ch == ".")), len(text))
    return text[:cut], text[cut:].strip().lower()


def parse_interval(interval: str) -> tuple[int, str]:
    """P10: ``'10m'`` → ``(10, 'minute')``.  A whole positive number directly
    followed by a known unit; anything else is a ``ValueError``."""
    number, unit = split_quantity(interval) if isinstance(interval, str) else ("", "")
    if not (number.isdecimal() and unit in _SPELLING and int(number) and " " not in interval.strip()):
        raise ValueError(f"not an interval such as 10s, 5m, 1h or 2d: {interval!r}")
    return int(number), _SPELLING[unit]


def interval_seconds(interval: str) -> int:
    n, unit = parse_interval(interval)
    return n * INTERVAL_UNITS[unit][0]


def spark_interval(interval: str) -> str:
    n, unit = parse_interval(interval)
    return f"{n} {unit}s" if n != 1 else f"1 {unit}"


def time_bucket(ts: Column, interval: str, ntz: bool = True) -> Column:
    """P10: floor a timestamp to an epoch-aligned bucket of ``interval``.

    Pure projection arithmetic (micros since the epoch, floored to a multiple
    of the width), so it keeps the column's type, leaves rows with a null
    time in place (their bucket is null) and can appear several times in one
    select.  ``ntz`` says whether ``ts`` is ``TIMESTAMP_NTZ`` (wall clock) or
    ``TIMESTAMP`` (instant, bucketed on UTC).
    """
    width = interval_seconds(interval) * 1_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") if ntz else F.timestamp_seconds(F.lit(0))
    micros = F.timestamp_diff("MICROSECOND", epoch, ts)
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, F.lit(width)), epoch)


def epoch_micros(df, time: str) -> Column:
    """Microseconds since the epoch of a time column (wall clock for NTZ)."""
    from pyspark.sql.types import TimestampNTZType
    ntz = isinstance(df.schema[time].dataType, TimestampNTZType)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") if ntz else F.timestamp_seconds(F.lit(0))
    return F.timestamp_diff("MICROSECOND", epoch, F.col(time))


def bucket_of(df, time: str, interval: str) -> Column:
    """``time_bucket`` for a column of ``df`` (picks NTZ / instant by schema)."""
    from pyspark.sql.types import TimestampNTZType
    ntz = isinstance(df.schema[time].dataType, TimestampNTZType)
    return time_bucket(F.col(time), interval, ntz)


def duckdb_interval(interval: str) -> str:
    """The same bucket width as a DuckDB interval literal (oracle helper)."""
    n, unit = parse_interval(interval)
    return f"INTERVAL '{n} {unit}s'"


def to_seconds_factor(unit: str) -> float:
    if unit not in SECONDS_PER_UNIT:
        raise ValueError(f"unknown duration unit {unit!r}")
    return SECONDS_PER_UNIT[unit]


def convert_duration(value: float, from_unit: str, to_unit: str) -> float:
    """Numeric duration conversion between s/ms/us/ns (one exact power-of-ten factor)."""
    to_seconds_factor(from_unit), to_seconds_factor(to_unit)
    d = UNIT_EXPONENT[from_unit] - UNIT_EXPONENT[to_unit]
    return value * (10 ** d if d >= 0 else float(f"1e{d}"))


def parse_duration(text: str, column_unit: str) -> float:
    """``'0.5s'`` / ``'500ms'`` / ``'250'`` → value in ``column_unit``.

    A bare number is already in the column's unit, as is one with a unit that
    is not a duration; text without a leading number is a ``ValueError``.
    """
    number, unit = split_quantity(text)
    known = UNIT_EXPONENT.keys() >= {unit, column_unit}
    return convert_duration(float(number), unit, column_unit) if known else float(number or text)


def to_millis(rt: Column, unit: str) -> Column:
    """Response time in ms from a column in ``unit``."""
    factor = convert_duration(1.0, unit, "ms")
    return rt * F.lit(factor) if factor != 1.0 else rt


def status_class(status: Column) -> Column:
    """Success / redirect / client_error / server_error / unknown."""
    status = status.try_cast("bigint")
    return (F.when(status.isNull(), F.lit("unknown"))
            .when(status < 300, F.lit("success"))
            .when(status < 400, F.lit("redirect"))
            .when(status < 500, F.lit("client_error"))
            .otherwise(F.lit("server_error")))


def status_group(status: Column) -> Column:
    """2xx/3xx/4xx/5xx label (everything below 300 is 2xx); else Unknown."""
    s = status.try_cast("bigint")
    return (F.when(s.isNull(), F.lit(UNKNOWN))
            .when(s < 300, F.lit("2xx"))
            .when(s < 400, F.lit("3xx"))
            .when(s < 500, F.lit("4xx"))
            .otherwise(F.lit("5xx")))


def target_key(ip: Column, port: Column) -> Column:
    """``ip:port``; ``Unknown`` when either part is missing."""
    return F.coalesce(F.concat(ip, F.lit(":"), port.cast("string")), F.lit(UNKNOWN))


def client_label(ip: Column) -> Column:
    """Client IP, ``Unknown`` when missing."""
    return F.coalesce(ip, F.lit(UNKNOWN))


def total_alb_time(req: Column, target: Column, resp: Column) -> Column:
    """Request + target + response processing time, missing parts as 0."""
    return F.coalesce(req, F.lit(0.0)) + F.coalesce(target, F.lit(0.0)) + F.coalesce(resp, F.lit(0.0))


def trailing_micros_as_seconds(tail: Column) -> Column:
    """A trailing integer token read as microseconds → seconds, else 0."""
    tok = F.regexp_extract(F.trim(tail), r"(?:^|\s)([0-9]+)$", 1)
    return F.when(tok == "", F.lit(0.0)).otherwise(tok.cast("double") / 1e6)


def size_label(nbytes: Column) -> Column:
    """``1.5KB`` style label with one decimal, rounded half-to-even.

    Units step by 1024, so the scaled value is exact in binary and the
    rounding can be done in integers: tenths = round_half_even(10*b / 1024^k).
    """
    b = nbytes.cast("bigint")
    out = None
    units = ["B", "KB", "MB", "GB", "TB"]
    for k, unit in enumerate(units):
        d = 1024 ** k
        tenths_num = b * 10
        q = F.floor(tenths_num.cast("decimal(38,0)") / F.lit(d)).cast("bigint") if d > 1 else tenths_num
        r = tenths_num - q * d
        q = (F.when(r * 2 > d, q + 1).when((r * 2 == d) & (q % 2 == 1), q + 1).otherwise(q)
             if d > 1 else q)
        text = F.concat(F.floor(q.cast("decimal(38,0)") / 10).cast("bigint").cast("string"), F.lit("."),
                        (q % 10).cast("string"), F.lit(unit))
        cond = b < F.lit(1024 ** (k + 1)) if unit != "TB" else F.lit(True)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return F.when(b.isNull(), F.lit(None).cast("string")).otherwise(out)
