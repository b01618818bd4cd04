"""Statistics.

Every function is one declarative aggregation: hash aggregate with a partial
(map-side) and a final stage, so a hot URL or IP costs one partial buffer per
task, never one task holding its rows.  Quantiles are exact: by default
(``exact="sort"``) a sketch computed beside the other aggregates bounds every
wanted rank and a second scan counts what lies between the bounds
(``operators/quantiles.py``), so a task holds a small share of a group, even if one key has a
third of all rows.  ``exact=True`` uses Spark's ``percentile`` instead (faster
on small groups; its buffer holds every *distinct* value of a group) and
``exact=False`` the bounded ``percentile_approx`` sketch.

Null keys are removed before every grouping, as pandas ``groupby`` drops them.
Values that are not numbers count as missing.  A field that is ``None`` or not
in the input leaves its metrics out instead of failing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.functions.exprs import bucket_of, to_millis
from reqlens.functions.rule_index import with_pattern
from reqlens.functions.urls import strip_query
from reqlens.operators.quantiles import quantiles_between, rank_bounds

# Metric set of the per-URL statistics and the summary.
URL_METRICS = ("avg", "sum", "median", "std", "min", "max", "p90", "p95", "p99")
SUMMARY_METRICS = ("avg", "median", "std", "min", "max", "p10", "p90", "p95", "p99")
_PROB = {"median": 0.5, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
APPROX_ACCURACY = 10000


def quantiles(col: Column, probs: Sequence[float], exact: bool | str = True) -> Column:
    """Linear-interpolated quantiles (pandas ``quantile``) as an array column."""
    if exact == "sort":
        raise ValueError("exact='sort' is computed as a table; use with_sorted_quantiles")
    if exact:
        return F.percentile(col, list(probs))
    return F.percentile_approx(col, list(probs), APPROX_ACCURACY)


def present(df: DataFrame, *fields: str | None) -> list[str]:
    """Those of ``fields`` that the input has."""
    return [f for f in fields if f is not None and f in df.columns]


def is_error(status: Column) -> Column:
    return status.try_cast("int") >= 400


def metric_aggs(col: str, metrics: Sequence[str], prefix: str, exact: bool | str = True
                ) -> tuple[list[Column], list[Column]]:
    """Aggregates for ``metrics`` of ``col`` plus the projections that name them.

    Returns ``(aggs, finals)``: the aggregate list (one ``percentile`` call for
    all quantiles) and the select list that unpacks it into ``prefix_metric``.
    With ``exact="sort"`` the quantiles are left out of the aggregate (they
    come from ``with_sorted_quantiles``) and the finals name them as columns.
    """
    if exact == "sort":
        simple = {"avg": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
        c = F.col(col).try_cast("double")
        aggs = [simple[m](c).alias(f"{prefix}_{m}") for m in metrics if m in simple]
        return aggs, [F.col(f"{prefix}_{m}") for m in metrics]
    c = F.col(col).try_cast("double")
    qs = [m for m in metrics if m in _PROB]
    aggs: list[Column] = []
    finals: list[Column] = []
    simple = {"avg": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
    for m in metrics:
        if m in simple:
            aggs.append(simple[m](c).alias(f"{prefix}_{m}"))
    qname = f"__q_{prefix}"
    if qs:
        aggs.append(quantiles(c, [_PROB[m] for m in qs], exact).alias(qname))
    for m in metrics:
        if m in simple:
            finals.append(F.col(f"{prefix}_{m}"))
        else:
            finals.append(F.col(qname)[qs.index(m)].alias(f"{prefix}_{m}"))
    return aggs, finals


def _sorted_probs(metrics: Sequence[str]) -> dict[str, float]:
    return {m: _PROB[m] for m in metrics if m in _PROB}


def bound_aggs(fields: Sequence[tuple[str, str]], metrics: Sequence[str], exact: bool | str) -> list[Column]:
    """The sketch aggregates that ``with_sorted_quantiles`` needs beside the others."""
    return rank_bounds(fields, list(_sorted_probs(metrics).values())) if exact == "sort" and fields else []


def with_sorted_quantiles(agg: DataFrame, rows: DataFrame, keys: Sequence[str],
                          fields: Sequence[tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """Join exact quantiles (``<prefix>_<metric>``) onto an aggregate of
    ``rows`` by ``keys`` that has the columns of ``bound_aggs``."""
    if not fields:
        return agg
    q = quantiles_between(rows, agg, keys, fields, _sorted_probs(metrics))
    if not keys:
        # a single global row: one scalar subquery returning all quantiles as a struct
        packed = q.select(F.struct(*q.columns).alias("s")).scalar()
        return agg.select("*", packed.alias("__q")).select(*agg.columns, "__q.*")
    return agg.join(q, list(keys), "left")


# ---------------------------------------------------------------------------
# A1 / A2: URL and URI-pattern extraction
# ---------------------------------------------------------------------------
def url_counts(df: DataFrame, url: str = "request_url", include_params: bool = False,
               min_count: int = 1, max_count: int | None = None) -> DataFrame:
    """A1: distinct URLs (query stripped unless ``include_params``) with counts."""
    u = F.col(url) if include_params else strip_query(F.col(url))
    out = df.groupBy(u.alias("url")).agg(F.count(F.lit(1)).alias("count"))
    cond = F.col("count") >= min_count
    if max_count is not None:
        cond = cond & (F.col("count") <= max_count)
    return out.filter(cond)


def uri_patterns(df: DataFrame, url: str = "request_url", include_params: bool = False,
                 min_count: int = 1, max_count: int | None = None, max_patterns: int | None = None,
                 rules=None) -> DataFrame:
    """A2: URI patterns with request counts; the ``max_patterns`` largest, or all.

    Counts exact URLs first, then generalises each *distinct* URL once and
    re-aggregates — the expensive string work runs per distinct URL, not per row.
    """
    per_url = url_counts(df, url, include_params)
    pat = with_pattern(per_url, "url", rules, "pattern").groupBy("pattern").agg(F.sum("count").alias("count"))
    cond = F.col("count") >= min_count
    if max_count is not None:
        cond = cond & (F.col("count") <= max_count)
    pat = pat.filter(cond).orderBy(F.desc("count"), F.asc_nulls_last("pattern"))
    return pat.limit(max_patterns) if max_patterns else pat


# ---------------------------------------------------------------------------
# summary
# ---------------------------------------------------------------------------
def summary_stats(df: DataFrame, url: str = "request_url", client_ip: str = "client_ip",
                  rt: str = "target_processing_time", byte_fields: Sequence[str] = (),
                  exact: bool | str = "sort") -> DataFrame:
    """A3 (+A13): one row — totals, distinct URLs/IPs, response-time metrics.

    ``byte_fields`` adds ``avg``/``std`` per byte column (A13).  The group is
    the whole input, so exact quantiles default to the range-sorted method
    (``exact=True`` would merge every distinct value of the input in one task).
    """
    timed = present(df, rt)
    aggs, finals = metric_aggs(rt, SUMMARY_METRICS, "response_time", exact) if timed else ([], [])
    for b in present(df, *byte_fields):
        a2, f2 = metric_aggs(b, ("avg", "std"), b, exact)
        aggs += a2
        finals += f2
    # Distinct counts are scalar subqueries over their own one-column
    # aggregation: two count(DISTINCT) in one aggregate would make Catalyst
    # expand every row three ways before the shuffle.
    def n_distinct(c: str) -> Column:
        return df.select(F.col(c).alias("k")).filter(F.col("k").isNotNull()).distinct() \
            .select(F.count(F.lit(1))).scalar()

    quantiled = [(f, "response_time") for f in timed]
    main = df.agg(F.count(F.lit(1)).alias("total_requests"), *aggs, *bound_aggs(quantiled, SUMMARY_METRICS, exact))
    if exact == "sort":
        main = with_sorted_quantiles(main, df, [], quantiled, SUMMARY_METRICS)
    unique = [n_distinct(c).alias(n) for c, n in ((url, "unique_urls"), (client_ip, "unique_ips")) if present(df, c)]
    return main.select("total_requests", *unique, *finals)


def status_distribution(df: DataFrame, status: str = "status", by: str | None = None) -> DataFrame:
    """A4: request count per status code (null codes excluded), optionally per key."""
    keys = [by, status] if by else [status]
    d = df.filter(F.col(status).isNotNull())
    if by:
        d = d.filter(F.col(by).isNotNull())
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def status_map(df: DataFrame, status: str, by: str) -> DataFrame:
    """Per-key status distribution as ``MAP<status, count>`` (bounded: one entry per code)."""
    dist = status_distribution(df, status, by)
    return dist.groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), F.col("count")))))
        .alias("status_codes"))


# ---------------------------------------------------------------------------
# Per-URL statistics
# ---------------------------------------------------------------------------
def url_stats(df: DataFrame, url: str = "request_url", status: str | None = "status",
              rt: str | None = "target_processing_time",
              processing_fields: Sequence[str] = (), byte_fields: Sequence[str] = (),
              sort_by: str | None = None, sort_metric: str = "avg", top_n: int | None = None,
              exact: bool | str = "sort", with_status_map: bool = False) -> DataFrame:
    """Per-URL count, response-time metrics, metrics per processing field.

    Columns: ``url, count, response_time_<m>…, <field>_<m>…``.  Sorted by
    ``sort_by``×``sort_metric`` (missing → 0) or by count, descending, ties by
    URL; ``top_n`` keeps the first N (a top-K, not a global sort).
    """
    d = df.filter(F.col(url).isNotNull())
    timed = present(df, rt)
    others = [f for f in present(df, *processing_fields) if f != rt]
    aggs: list[Column] = [F.count(F.lit(1)).alias("count")]
    named: dict[str, list[Column]] = {}
    for fld, prefix in [(f, "response_time") for f in timed] + [(f, f) for f in others]:
        a, named[fld] = metric_aggs(fld, URL_METRICS, prefix, exact)
        aggs += a
    finals: list[Column] = [F.col(url).alias("url"), F.col("count"), *(named[rt] if timed else [])]
    for fld in present(df, *processing_fields):
        # the response time may be a processing field as well: computed once, named twice
        finals += [c.alias(f"{fld}_{m}") for c, m in zip(named[fld], URL_METRICS)] if fld == rt else named[fld]
    for b in present(df, *byte_fields):
        a, f = metric_aggs(b, ("avg", "std"), b, exact)
        aggs += a
        finals += f
    quantiled = [(f, "response_time") for f in timed] + [(f, f) for f in others]
    out = d.groupBy(url).agg(*aggs, *bound_aggs(quantiled, URL_METRICS, exact))
    if exact == "sort":
        out = with_sorted_quantiles(out, d, [url], quantiled, URL_METRICS)
    out = out.select(*finals)
    if with_status_map and present(df, status):
        smap = status_map(d, status, url).withColumnRenamed(url, "url")
        out = out.join(smap, "url", "left")
    if sort_by and sort_by != "count":
        key = f"{sort_by}_{sort_metric}"
        if timed and sort_by == rt:
            key = f"response_time_{sort_metric}"
        order = F.coalesce(F.col(key), F.lit(0.0)) if key in out.columns else F.lit(0.0)
    else:
        order = F.col("count")
    out = out.orderBy(order.desc(), F.asc("url"))
    if top_n and top_n > 0:
        out = out.limit(top_n)
    return out


# ---------------------------------------------------------------------------
# Per-interval statistics
# ---------------------------------------------------------------------------
def time_stats(df: DataFrame, time: str = "time", status: str | None = "status",
               rt: str | None = "target_processing_time", interval: str = "10m",
               exact: bool | str = "sort") -> DataFrame:
    """Per bucket — count, errors (status ≥ 400), error rate over all rows,
    average and p95 response time; ascending time."""
    fields = [F.col(c).alias(n) for c, n in ((status, "__s"), (rt, "__rt")) if present(df, c)]
    rows = df.filter(F.col(time).isNotNull()).select(bucket_of(df, time, interval).alias("time_bucket"), *fields)
    coded, timed = present(rows, "__s"), present(rows, "__rt")
    aggs = [F.count(F.lit(1)).alias("count")]
    if coded:
        aggs.append(F.count_if(is_error(F.col("__s"))).alias("error_count"))
    if timed:
        rows = rows.withColumn("__rt", F.col("__rt").try_cast("double"))
        aggs.append(F.avg("__rt").alias("avg_response_time"))
        if exact != "sort":
            aggs.append(quantiles(F.col("__rt"), [0.95], exact)[0].alias("p95_response_time"))
    quantiled = [(f, "rt") for f in timed]
    out = rows.groupBy("time_bucket").agg(*aggs, *bound_aggs(quantiled, ["p95"], exact))
    if exact == "sort":
        out = with_sorted_quantiles(out, rows, ["time_bucket"], quantiled, ["p95"]) \
            .withColumnRenamed("rt_p95", "p95_response_time")
    if coded:
        out = out.withColumn("error_rate", F.col("error_count") / F.col("count"))
    order = ("time_bucket", "count", "error_count", "error_rate", "avg_response_time", "p95_response_time")
    return out.select(*present(out, *order)).orderBy("time_bucket")


# ---------------------------------------------------------------------------
# Per-client statistics
# ---------------------------------------------------------------------------
def ip_stats(df: DataFrame, client_ip: str = "client_ip", status: str | None = "status",
             rt: str | None = "target_processing_time", top: int | None = None) -> DataFrame:
    """Per-IP count, errors, average response time, by count; the ``top``
    first, or all of them."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if present(df, status):
        aggs.append(F.count_if(is_error(F.col(status))).alias("error_count"))
    if present(df, rt):
        aggs.append(F.avg(F.col(rt).try_cast("double")).alias("avg_response_time"))
    out = df.filter(F.col(client_ip).isNotNull()).groupBy(F.col(client_ip).alias("ip")).agg(*aggs)
    out = out.orderBy(F.desc("count"), F.asc("ip"))
    return out if top is None else out.limit(top)


# ---------------------------------------------------------------------------
# Per-minute tables
# ---------------------------------------------------------------------------
def minute_table(df: DataFrame, time: str = "time", status: str = "status",
                 rt: str = "target_processing_time", exact: bool | str = "sort") -> DataFrame:
    """A10: per minute — requests, errors, error % of all rows, exact-code
    counts (200/400/500, reference parity) and class counts (2xx/4xx/5xx),
    average / p95 / p99 response time."""
    s, r = F.col("__s"), F.col("__rt")
    rows = df.filter(F.col(time).isNotNull()).select(
        bucket_of(df, time, "1min").alias("time"), F.col(status).try_cast("int").alias("__s"), F.col(rt).try_cast("double").alias("__rt"))
    out = (rows.groupBy("time")
            .agg(F.count(F.lit(1)).alias("request_count"),
                 F.count_if(s >= 400).alias("error_count"),
                 F.count_if(s == 200).alias("status_2xx"),
                 F.count_if(s == 400).alias("status_4xx"),
                 F.count_if(s == 500).alias("status_5xx"),
                 F.count_if((s >= 200) & (s < 300)).alias("class_2xx"),
                 F.count_if((s >= 400) & (s < 500)).alias("class_4xx"),
                 F.count_if(s >= 500).alias("class_5xx"),
                 F.avg(r).alias("avg_response_time"),
                 *(bound_aggs([("__rt", "rt")], ["p95", "p99"], exact) or [quantiles(r, [0.95, 0.99], exact).alias("__q")])))
    if exact == "sort":
        out = with_sorted_quantiles(out, rows, ["time"], [("__rt", "rt")], ["p95", "p99"])
        q95, q99 = F.col("rt_p95"), F.col("rt_p99")
    else:
        q95, q99 = F.col("__q")[0], F.col("__q")[1]
    return (out.select("time", "request_count", "error_count",
                       (F.col("error_count") / F.col("request_count") * 100).alias("error_rate"),
                       "status_2xx", "status_4xx", "status_5xx", "class_2xx", "class_4xx", "class_5xx",
                       "avg_response_time", q95.alias("p95_response_time"), q99.alias("p99_response_time"))
            .orderBy("time"))


def dashboard_minutes(df: DataFrame, time: str = "time", status: str = "status",
                      rt: str = "target_processing_time", rt_unit: str = "s") -> DataFrame:
    """Per minute — requests, average response time in ms, errors, and
    error % among rows that have a status."""
    s = F.col(status).try_cast("int")
    return (df.filter(F.col(time).isNotNull())
            .groupBy(bucket_of(df, time, "1min").alias("time"))
            .agg(F.count(F.lit(1)).alias("request_count"),
                 F.avg(to_millis(F.col(rt).try_cast("double"), rt_unit)).alias("avg_response_time_ms"),
                 F.count_if(s >= 400).alias("error_count"),
                 (F.avg((s >= 400).cast("double")) * 100).alias("error_rate"))
            .orderBy("time"))


# ---------------------------------------------------------------------------
# Several sections over one load
# ---------------------------------------------------------------------------
def calculate_stats(df: DataFrame, stats_types: Sequence[str] = ("all",), *, url: str = "request_url",
                    time: str = "time", status: str = "status", rt: str | None = "target_processing_time",
                    client_ip: str = "client_ip", interval: str = "10m", top_ips: int | None = None,
                    exact: bool | str = "sort",
                    processing_fields: Sequence[str] = (), sort_by: str | None = None,
                    sort_metric: str = "avg", top_n: int | None = None,
                    materialize: str | None = None) -> dict[str, DataFrame]:
    """``{'summary', 'status_distribution', 'url_stats', 'time_stats',
    'ip_stats'}`` over one input; a section whose key field is absent is left out.

    ``materialize='snapshot'`` lands the input once as Parquet in the shared
    checkpoint folder (cuts lineage, survives executor loss, and every
    section then scans only its columns) — the choice for an expensive text
    source; ``'persist'`` caches it (memory and disk); ``None`` lets each
    section scan the input (right when it already is Parquet).
    """
    kinds = set(stats_types)
    if "all" in kinds:
        kinds = {"summary", "url", "time", "ip"}
    src = df
    if materialize == "persist":
        src = df.persist(StorageLevel.MEMORY_AND_DISK)
    elif materialize == "snapshot":
        from reqlens.session import shared_dir
        path = shared_dir(df.sparkSession, "stats-input")
        df.write.parquet(path)
        src = df.sparkSession.read.parquet(path)
    out: dict[str, DataFrame] = {}
    if "summary" in kinds:
        out["summary"] = summary_stats(src, url, client_ip, rt, exact=exact)
        if present(src, status):
            out["status_distribution"] = status_distribution(src, status)
    if "url" in kinds and present(src, url):
        out["url_stats"] = url_stats(src, url, status, rt, processing_fields, sort_by=sort_by,
                                     sort_metric=sort_metric, top_n=top_n, exact=exact)
    if "time" in kinds and present(src, time):
        out["time_stats"] = time_stats(src, time, status, rt, interval, exact=exact)
    if "ip" in kinds and present(src, client_ip):
        out["ip_stats"] = ip_stats(src, client_ip, status, rt, top_ips)
    return out
