"""Exact per-group quantiles without holding a group in one task.

Spark's ``percentile`` keeps, per group, a map of every distinct value; the
final merge of a hot group happens in one task.  The functions here give the same
linear-interpolated result (pandas ``quantile``) in two scans:

1. ``rank_bounds``: beside the other aggregates of the group, a mergeable sketch
   (``percentile_approx``, whose rank error is at most ``1 / ACCURACY`` of the
   group) gives for every probability a low and a high value around the wanted rank.
   The split points so come from the group's own data, whatever its range is.
2. ``quantiles_between``: every value falls in one of the intervals between
   these bounds or in a gap.  Values in an interval are counted one by one, a
   gap is one cell with its count, least and greatest value.  Cells come in
   value order, so running counts are exact ranks; a wanted rank that is the
   first or last of its cell, or whose cell has one value, is answered.

   A group's task holds its cells: about ``4 / ACCURACY`` of its rows per probability.
   In a group of more than ``LARGE`` rows intervals are cut into ``PARTS`` even parts,
   one cell each; the part that holds a wanted rank is split again, into
   its values, by one more scan that is not run where no group is large.  (That scan takes
   rows by the part's range of values; a rank left open fails the job, it is never guessed.)

Values that are null, NaN or no numbers are not counted.  Groups with a null
key give no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: the sketch's rank error is at most one in this many of the group's rows
ACCURACY = 1000
#: rows of a group (and field) up to which every value of an interval is a cell
LARGE = 100_000_000
#: cells of an interval in larger groups
PARTS = 1 << 14


def _number(col: str) -> Column:
    v = F.col(col).try_cast("double")
    return F.when(~F.isnan(v), v)


def rank_bounds(fields: Sequence[tuple[str, str]], probs: Sequence[float]) -> list[Column]:
    """Aggregates for ``quantiles_between``, to be put beside others:
    ``fields`` is ``[(column, prefix)]``."""
    ps = sorted(probs)
    around = [max(0.0, p - 2 / ACCURACY) for p in ps] + [min(1.0, p + 2 / ACCURACY) for p in ps]
    out = []
    for col, prefix in fields:
        out += [F.percentile_approx(_number(col), around, ACCURACY).alias(f"__b_{prefix}"),
                F.count(_number(col)).alias(f"__n_{prefix}")]
    return out


def _piece(v: Column, bounds: Column, m: int) -> Column:
    """Number of the interval that holds a value, or a negative one for a gap."""
    piece = F.when(v < bounds[0], F.lit(-1)).when(v <= bounds[m], F.lit(0))
    for i in range(1, m):
        piece = piece.when(v < bounds[i], F.lit(-1 - i)).when(v <= bounds[m + i], F.lit(i))
    return piece.otherwise(F.lit(-1 - m))


def _cell(v: Column, piece: Column, low: Column, high: Column, n: Column) -> Column:
    """The cell of a value: itself, or its part of the interval, or null in a gap."""
    part = F.least(F.floor((v - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("double")
    part = F.when((low < high) & (high - low < float("inf")), part).otherwise(F.lit(0.0))
    return F.when(piece >= 0, F.when(n <= LARGE, v).otherwise(part))


def _interpolated(lo: Column, hi: Column, frac: Column) -> Column:
    inf = float("inf")
    return (F.when((lo == hi) | (frac == 0), lo)
            .when((F.abs(lo) == inf) | (F.abs(hi) == inf), lo * (1 - frac) + hi * frac)
            .otherwise(lo + (hi - lo) * frac))


def quantiles_between(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, str]],
                      metrics: Mapping[str, float]) -> DataFrame:
    """One row per group with ``<prefix>_<metric>`` for every field and metric.

    ``bounds`` has the keys and the columns of ``rank_bounds`` for the same
    fields and ``metrics.values()``, one row per group of ``rows``.
    """
    keys, prefixes = list(keys), [p for _, p in fields]
    ps = sorted(metrics.values())
    m = len(ps)
    extra = [f"__{x}_{p}" for p in prefixes for x in "bn"]
    wanted = rows.select(*keys, *(_number(c).alias(f"__v_{p}") for c, p in fields))
    if keys:
        joined = wanted.join(bounds.select(*keys, *extra), keys)
    else:       # one global row of bounds: a scalar subquery
        one = bounds.select(F.struct(*extra).alias("s")).scalar()
        joined = wanted.withColumn("__s", one).select("*", "__s.*")

    # the piece is its own projection: inlined into the cell it would be evaluated over and over
    joined = joined.select("*", *(_piece(F.col(f"__v_{p}"), F.col(f"__b_{p}"), m).alias(f"__p_{p}") for p in prefixes))

    def placed(p: str) -> Column:
        b, piece = F.col(f"__b_{p}"), F.col(f"__p_{p}")
        return F.struct(F.lit(p).alias("f"), F.col(f"__v_{p}").alias("v"), piece.alias("piece"),
                        F.get(b, piece).alias("low"), F.get(b, piece + m).alias("high"), F.col(f"__n_{p}").alias("n"))
    values = (joined.select(*keys, F.explode(F.array(*map(placed, prefixes))).alias("__x")).where("__x.v IS NOT NULL")
              .select(*keys, F.col("__x.f").alias("__f"), F.col("__x.v").alias("__v"), F.col("__x.piece").alias("__piece"),
                      _cell(*(F.col(f"__x.{c}") for c in ("v", "piece", "low", "high", "n"))).alias("__cell")))
    place = [*keys, "__f", "__piece", "__cell"]
    cells = values.groupBy(*place).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    group = Window.partitionBy(*keys, "__f")
    ranked = cells.withColumns({
        "__end": F.sum("__c").over(group.orderBy("__lo").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(group)})

    start = F.col("__end") - F.col("__c")
    at = [(F.lit(p) * (F.col("__n") - 1)) for p in ps]
    ranks = [f(a).cast("long") for a in at for f in (F.floor, F.ceil)]

    def answer(k: Column) -> Column:
        known = (F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).when(k == start, F.col("__lo"))
                 .when(k == F.col("__end") - 1, F.col("__hi")))
        return F.max(F.when((k >= start) & (k < F.col("__end")), known))
    found = ranked.groupBy(*keys, "__f").agg(F.max("__n").alias("__n"), *(answer(k).alias(f"__r{j}") for j, k in enumerate(ranks)))

    # parts of large groups that hold an unanswered rank; a piece below 0 cannot: its inner ranks are never wanted
    within = [(k > start) & (k < F.col("__end") - 1) for k in ranks]
    open_parts = (ranked.where("__n > " + str(LARGE)).where("__piece >= 0 AND __lo < __hi")
                  .select(*place, "__lo", "__hi", start.alias("__start"), *(F.when(w, k).alias(f"__k{j}") for j, (w, k) in enumerate(zip(within, ranks))))
                  .where(F.coalesce(*(F.col(f"__k{j}") for j in range(2 * m))).isNotNull()))
    # at most two parts per probability, field and group of more than LARGE rows; a part is its range of values
    mine = open_parts.withColumnsRenamed({k: f"__part_{k}" for k in (*keys, "__f")})
    in_part = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    for k in (*keys, "__f"):
        in_part = in_part & (F.col(k) == F.col(f"__part_{k}"))
    again = (values.select(*keys, "__f", "__v").join(F.broadcast(mine), in_part)
             .groupBy(*place, "__v", "__start", *(f"__k{j}" for j in range(2 * m))).agg(F.count(F.lit(1)).alias("__c")))
    inside = Window.partitionBy(*place).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("__end", F.col("__start") + F.sum("__c").over(inside))
    split = again.groupBy(*keys, "__f").agg(*(
        F.max(F.when((F.col(f"__k{j}") >= start) & (F.col(f"__k{j}") < F.col("__end")), F.col("__v"))).alias(f"__s{j}")
        for j in range(2 * m)))
    split = split.withColumnsRenamed({k: f"__own_{k}" for k in keys}).withColumnRenamed("__f", "__own_f")
    same = F.col("__f") == F.col("__own_f")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__own_{k}"))
    found = found.join(split, same, "left")

    value, missed = {}, F.raise_error("a wanted rank lies outside its bounds").cast("double")
    for j, p in enumerate(ps):
        lo, hi = (F.coalesce(F.col(f"__r{i}"), F.col(f"__s{i}"), missed) for i in (2 * j, 2 * j + 1))
        idx = F.lit(p) * (F.col("__n") - 1)
        value[p] = _interpolated(lo, hi, idx - F.floor(idx))
    return found.groupBy(*keys).agg(*(
        F.max(F.when(F.col("__f") == prefix, value[p])).alias(f"{prefix}_{name}") for prefix in prefixes for name, p in metrics.items()))


def stacked_quantiles(df: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, str]],
                      metrics: Mapping[str, float]) -> DataFrame:
    """Quantiles of several columns: ``fields`` is ``[(column, prefix)]``,
    ``metrics`` maps a metric name to its probability; the result has one row
    per group and columns ``<prefix>_<metric>``."""
    bounds = df.groupBy(*keys).agg(*rank_bounds(fields, list(metrics.values())))
    return quantiles_between(df, bounds, keys, fields, metrics)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """``(keys..., <name_i>)`` — the ``probs[i]`` quantile of ``value`` per
    group that has a value."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    q = stacked_quantiles(df, keys, [(value, "v")], dict(zip(names, probs)))
    return q.select(*keys, *(F.col(f"v_{n}").alias(n) for n in names))
