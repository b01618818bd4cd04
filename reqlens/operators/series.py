"""Top-N time series with an ``Others`` bucket (T1–T14) and the scatter set.

Shape of every series: label each row → bucket its time → choose leaders over
the whole input → relabel the rest ``Others`` (never ``Unknown``) →
aggregate per (bucket, label).

Plan shape, chosen for scale:

* Additive metrics (counts, sums) are pre-aggregated to ``(bucket, label)``
  cells first; leaders and the final series are computed from the cells, so
  the raw rows are shuffled once, already combined map-side, and a hot label
  costs one partial buffer per task.
* Leaders are a top-K (at most ``top_n`` rows) and are joined back without a
  hint: Spark sees their size at run time and broadcasts them if small.
* Non-additive metrics (median, p95, p99) are computed from relabelled raw
  rows, because ``Others`` must be recomputed from its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.functions.exprs import bucket_of, client_label, status_class, target_key, to_millis
from reqlens.functions.rule_index import with_pattern
from reqlens.functions.urls import (OTHERS, UNKNOWN, Rule, rules_from_patterns, scatter_label, url_pattern_label)
from reqlens.operators.rules import merge_rules
from reqlens.operators.quantiles import group_quantiles
from reqlens.operators.stats import quantiles

LABEL = "label"
BUCKET = "time_bucket"


# ---------------------------------------------------------------------------
# leaders / Others core
# ---------------------------------------------------------------------------
def leaders(cells: DataFrame, value: str, top_n: int, label: str = LABEL) -> DataFrame:
    """The ``top_n`` labels with the largest total ``value``; ties by label."""
    tot = cells.groupBy(label).agg(F.sum(value).alias("__total"))
    return tot.orderBy(F.desc("__total"), F.asc(label)).limit(top_n).select(label)


def relabel(df: DataFrame, lead: DataFrame, label: str = LABEL, keep_unknown: bool = True) -> DataFrame:
    """Labels not among ``lead`` become ``Others`` (``Unknown`` is kept)."""
    flagged = lead.select(F.col(label).alias("__lead")).distinct()
    j = df.join(flagged, F.col(label) == F.col("__lead"), "left")
    keep = F.col("__lead").isNotNull()
    if keep_unknown:
        keep = keep | (F.col(label) == UNKNOWN)
    return j.withColumn(label, F.when(keep, F.col(label)).otherwise(F.lit(OTHERS))).drop("__lead")


def _lead_from_labels(spark, labels: Sequence[str], label: str = LABEL) -> DataFrame:
    return spark.createDataFrame([(x,) for x in dict.fromkeys(labels)], f"{label} STRING")


def rule_leaders(spark, rules: Sequence[Rule], generalize: bool = True) -> list[str]:
    """Leader labels from a rule set — the replacements, each passed
    through the rule-first generalisation itself (as URLs would be)."""
    reps = [r.replacement for r in rules if r.replacement]
    if not generalize:
        return list(dict.fromkeys(reps))
    if not reps:
        return []
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(reps)], "p STRING")
    out = with_pattern(df, "p", rules, "label").select("label").distinct().collect()
    return sorted(r["label"] for r in out)


def _top_series(cells: DataFrame, value: str, top_n: int, lead: DataFrame | None,
                agg=F.sum) -> DataFrame:
    """Relabel additive cells and re-aggregate them per (bucket, label)."""
    lead = lead if lead is not None else leaders(cells, value, top_n)
    return relabel(cells, lead).groupBy(BUCKET, LABEL).agg(agg(value).alias(value))


def label_distinct_urls(df: DataFrame, url: str, rules: Sequence[Rule] | None = None,
                        label: str = LABEL) -> DataFrame:
    """Add the URI-pattern label by generalising each *distinct* URL once and
    joining the map back on the URL.  Spark sizes the map at run time (AQE):
    a small map is broadcast, a large one joins by shuffle with skew
    splitting — no hint, so nothing unbounded is broadcast."""
    urls = df.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull()).distinct()
    lab = with_pattern(urls, "__url", rules, label)
    j = df.join(lab, F.col(url) == F.col("__url"), "left")
    return j.withColumn(label, F.coalesce(F.col(label), F.lit(UNKNOWN))).drop("__url", url)


# ---------------------------------------------------------------------------
# Request counts per URI pattern, target, client
# ---------------------------------------------------------------------------
def _count_series(df: DataFrame, time: str, key: Column, interval: str, top_n: int,
                  lead_labels: Sequence[str] | None = None, url_rules=False) -> DataFrame:
    """Counts per (bucket, label).  Rows are first counted per (bucket, raw
    key); for URL series (``url_rules`` not False) the key is then labelled
    through the distinct-URL map, so generalisation runs once per distinct
    URL and the counts add up exactly."""
    d = df.filter(F.col(time).isNotNull())
    cells = (d.select(bucket_of(d, time, interval).alias(BUCKET), key.alias("__key"))
             .groupBy(BUCKET, "__key").agg(F.count(F.lit(1)).alias("count")))
    if url_rules is not False:
        cells = (label_distinct_urls(cells, "__key", url_rules)
                 .groupBy(BUCKET, LABEL).agg(F.sum("count").alias("count")))
    else:
        cells = cells.withColumnRenamed("__key", LABEL)
    lead = _lead_from_labels(df.sparkSession, lead_labels) if lead_labels is not None else None
    return _top_series(cells, "count", top_n, lead)


def requests_per_uri(df: DataFrame, time: str = "time", url: str = "request_url", interval: str = "10s",
                     top_n: int = 20, rules: Sequence[Rule] | None = None) -> DataFrame:
    """T1 (+T7): ``(time_bucket, label, count)``; leaders by request count, or
    the rule set's patterns when ``rules`` is given."""
    lead = rule_leaders(df.sparkSession, rules) if rules else None
    return _count_series(df, time, F.col(url), interval, top_n, lead, url_rules=list(rules) if rules else None)


def requests_per_target(df: DataFrame, time: str = "time", ip: str = "target_ip", port: str = "target_port",
                        interval: str = "10s", top_n: int = 20) -> DataFrame:
    """``(time_bucket, label=ip:port|Unknown|Others, count)``."""
    return _count_series(df, time, target_key(F.col(ip), F.col(port)), interval, top_n)


def requests_per_client(df: DataFrame, time: str = "time", client_ip: str = "client_ip",
                        interval: str = "10s", top_n: int = 20) -> DataFrame:
    """``(time_bucket, label=client ip|Unknown|Others, count)``."""
    return _count_series(df, time, client_label(F.col(client_ip)), interval, top_n)


# ---------------------------------------------------------------------------
# T4 / T5: bytes per URI pattern
# ---------------------------------------------------------------------------
def bytes_per_uri(df: DataFrame, bytes_col: str = "received_bytes", time: str = "time",
                  url: str = "request_url", interval: str = "10s", top_n: int = 10,
                  rules: Sequence[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """T4/T5: per (bucket, pattern) sum and mean of a byte column.

    Returns ``(cells, ranking)``.  Leaders are the ``top_n`` patterns by total
    sum (or the rule replacements, used as they are); other patterns are
    dropped — there is no ``Others`` here.  ``ranking`` has, per leader, the
    total sum and the unweighted mean of its bucket means, with a rank for each.
    """
    d = df.filter(F.col(time).isNotNull() & F.col(bytes_col).isNotNull())
    b = F.col(bytes_col).try_cast("double")
    # per (bucket, raw URL) first; the URL is generalised on those cells only
    raw = (d.select(bucket_of(d, time, interval).alias(BUCKET), F.col(url).alias("__u"), b.alias("__b"))
           .groupBy(BUCKET, "__u").agg(F.sum("__b").alias("__s"), F.count(F.lit(1)).alias("__n")))
    cells = (label_distinct_urls(raw, "__u", rules).groupBy(BUCKET, LABEL)
             .agg(F.sum("__s").alias("sum_bytes"), (F.sum("__s") / F.sum("__n")).alias("avg_bytes")))
    if rules:
        lead = _lead_from_labels(df.sparkSession, rule_leaders(df.sparkSession, rules, generalize=False))
    else:
        lead = leaders(cells, "sum_bytes", top_n)
    kept = cells.join(lead, LABEL, "left_semi")
    rank = kept.groupBy(LABEL).agg(F.sum("sum_bytes").alias("total_sum"), F.avg("avg_bytes").alias("mean_avg"))
    rank = (rank.withColumn("rank_sum", F.row_number().over(
                _w_global(F.desc("total_sum"), F.asc(LABEL))))
                .withColumn("rank_avg", F.row_number().over(_w_global(F.desc("mean_avg"), F.asc(LABEL)))))
    return kept, rank


def _w_global(*order):
    # A window over a table of at most ``top_n`` leaders (bounded by the limit).
    return Window.orderBy(*order)


# ---------------------------------------------------------------------------
# Processing time per URI pattern
# ---------------------------------------------------------------------------
_METRICS = ("avg", "sum", "median", "p95", "p99", "max")


def processing_time_per_uri(df: DataFrame, field: str = "target_processing_time", metric: str = "avg",
                            time: str = "time", url: str = "request_url", interval: str = "1min",
                            top_n: int = 10, rules: Sequence[Rule] | None = None,
                            exact: bool | str = "sort") -> DataFrame:
    """``(time_bucket, label, value)``; leaders by total ``field``,
    ``Others`` recomputed from its raw rows for every metric.  Every distinct
    URL is labelled once, with its total; rows get the final label
    through that map."""
    if metric not in _METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {_METRICS}")
    d = df.filter(F.col(time).isNotNull() & F.col(field).try_cast("double").isNotNull())
    rows = d.select(bucket_of(d, time, interval).alias(BUCKET), F.col(url).alias("__u"), F.col(field).try_cast("double").alias("__v"))
    urls = (rows.groupBy(F.col("__u").alias("__url")).agg(F.sum("__v").alias("__s"))
            .where("__url IS NOT NULL"))
    urls = with_pattern(urls, "__url", rules, LABEL)
    if rules:
        lead = _lead_from_labels(df.sparkSession, rule_leaders(df.sparkSession, rules))
    else:
        # rows without a URL are Unknown, and may be a leader
        unknown = rows.where("__u IS NULL").groupBy(F.lit(UNKNOWN).alias(LABEL)).agg(F.sum("__v").alias("__s"))
        lead = leaders(urls.select(LABEL, "__s").union(unknown), "__s", top_n)
    final = relabel(urls, lead).select("__url", LABEL)
    rel = (rows.join(final, F.col("__u") == F.col("__url"), "left")
           .select(BUCKET, F.coalesce(F.col(LABEL), F.lit(UNKNOWN)).alias(LABEL), "__v"))
    prob = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    if metric in prob and exact == "sort":
        return group_quantiles(rel, [BUCKET, LABEL], "__v", [prob[metric]], names=["value"])
    agg = {"avg": F.avg("__v"), "sum": F.sum("__v"), "max": F.max("__v")}.get(metric)
    if agg is None:
        agg = quantiles(F.col("__v"), [prob[metric]], exact)[0]
    return rel.groupBy(BUCKET, LABEL).agg(agg.alias("value"))


# ---------------------------------------------------------------------------
# Leaders → rules → merged rule store
# ---------------------------------------------------------------------------
def leaders_to_rules(lead: DataFrame, label: str = LABEL, max_rules: int = 10000) -> list[Rule]:
    """Leader patterns (a top-N, so bounded) as wildcard rules, in order."""
    rows = lead.limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} leaders")
    return rules_from_patterns([r[label] for r in rows if r[label] not in (None, OTHERS, UNKNOWN)])


def update_rule_store(spark, store: DataFrame | None, lead: DataFrame, label: str = LABEL) -> DataFrame:
    """T8 + K8: merge new leader rules into an existing rule table."""
    new = leaders_to_rules(lead, label)
    new_df = spark.createDataFrame([(i, r.pattern, r.replacement) for i, r in enumerate(new)],
                                   "ord INT, pattern STRING, replacement STRING")
    return merge_rules(store, new_df) if store is not None else merge_rules(None, new_df)


# ---------------------------------------------------------------------------
# Display ranking
# ---------------------------------------------------------------------------
def display_ranking(cells: DataFrame, value: str, top_n: int | None = None,
                    others_last: bool = True) -> DataFrame:
    """Labels ordered by the sum over buckets of ``value``; the first
    ``top_n`` non-``Others`` labels (ranked 1..n), then ``Others`` last when
    ``others_last``.  Without ``top_n`` all labels are returned, sorted."""
    from pyspark.sql import Window
    tot = cells.groupBy(LABEL).agg(F.sum(value).alias("total"))
    named = tot.filter(F.col(LABEL) != OTHERS) if others_last else tot
    order = [F.desc("total"), F.asc(LABEL)]
    if not top_n:
        return tot.orderBy(*order)
    # at most top_n rows after the limit: a bounded window for the rank
    named = named.orderBy(*order).limit(top_n)
    named = named.withColumn("display_rank", F.row_number().over(Window.orderBy(*order)))
    if not others_last:
        return named
    oth = tot.filter(F.col(LABEL) == OTHERS).withColumn("display_rank", F.lit(top_n + 1))
    return named.unionByName(oth)


# ---------------------------------------------------------------------------
# Response-time scatter set
# ---------------------------------------------------------------------------
def scatter_points(df: DataFrame, time: str = "time", rt: str = "target_processing_time",
                   status: str = "status", rt_unit: str = "s", group_by: str = "status",
                   url: str = "request_url", target_ip: str = "target_ip",
                   rules: Sequence[Rule] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(time, response_ms, status, status_class, group)`` for rows
    with a time and a response time.  ``group`` is the status class, the URL
    label (P7) or the target IP (null IPs dropped; if no row has one, the
    status class is used)."""
    d = df.filter(F.col(time).isNotNull() & F.col(rt).try_cast("double").isNotNull())
    cls = status_class(F.col(status))
    if group_by == "url":
        grp = scatter_label(F.col(url), list(rules) if rules else None)
    elif group_by == "ip":
        has_ip = d.filter(F.col(target_ip).isNotNull()).limit(1).count() > 0
        if has_ip:
            d = d.filter(F.col(target_ip).isNotNull())
            grp = F.col(target_ip)
        else:
            grp = cls
    else:
        grp = cls
    return d.select(*keep, F.col(time).alias("time"),
                    to_millis(F.col(rt).try_cast("double"), rt_unit).alias("response_ms"),
                    F.col(status).alias("status"), cls.alias("status_class"), grp.alias("group"))


def group_sizes(points: DataFrame) -> DataFrame:
    """Points per group, largest first (ties by group)."""
    return points.groupBy("group").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "group")


#: hexadecimal digits of the hash that are counted before the cut
_COUNTED = 5


def downsample(points: DataFrame, key: Sequence[str], max_points: int | None, seed: int = 42) -> DataFrame:
    """The ``max_points`` rows whose key has the smallest seeded hash,
    ``md5(seed|key...)``, ties by key; all rows if there are fewer, or for None.

    Exactly ``orderBy(hash).limit(n)``, but no task merges ``n`` rows of every
    other one: rows are counted by the first digits of their hash (at most 16 ** 5
    counters, added up on the map side, reading the key alone), the running
    count gives the last digits that are needed, and only rows up to them, hardly
    more than ``max_points``, reach the final top-K.  One lazy plan, two scans."""
    if max_points is None:
        return points
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))
    head = lambda c: F.conv(F.substring(c, 1, _COUNTED), 16, 10).cast("long")
    per = points.select(head(h).alias("__b")).groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    so_far = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    last = (per.withColumn("__s", F.sum("__c").over(so_far)).where(F.col("__s") >= max_points)
            .agg(F.coalesce(F.min("__b"), F.lit(16 ** _COUNTED))).scalar())
    return (points.withColumn("__h", h).where(head(F.col("__h")) <= last)
            .orderBy("__h", *key).limit(max_points).drop("__h"))


def scatter_counters(df: DataFrame, sample: DataFrame, n_rules: int = 0) -> DataFrame:
    """Original rows, plotted rows, distinct groups, rules applied — one
    aggregation over the tagged union of input and sample (one row)."""
    orig = df.select(F.lit(1).alias("__o"), F.lit(0).alias("__p"), F.lit(None).cast("string").alias("__g"))
    plot = sample.select(F.lit(0).alias("__o"), F.lit(1).alias("__p"), F.col("group").cast("string").alias("__g"))
    return orig.unionByName(plot).agg(
        F.sum("__o").cast("bigint").alias("original_rows"),
        F.sum("__p").cast("bigint").alias("plotted_rows"),
        F.count_distinct("__g").alias("distinct_groups"),
        F.lit(n_rules).alias("patterns_applied"))


def series_wide(cells: DataFrame, value: str, labels: Sequence[str] | None = None,
                max_labels: int = 1000) -> DataFrame:
    """The chart grid: one row per bucket, one column per label, absent
    cells 0 (the reference's ``unstack(fill_value=0)``).  A series has at most
    ``top_n`` + 2 labels; without ``labels`` they are fetched (size-checked)."""
    if labels is None:
        got = [r[LABEL] for r in cells.select(LABEL).distinct().orderBy(LABEL).limit(max_labels + 1).collect()]
        if len(got) > max_labels:
            raise ValueError(f"more than {max_labels} labels; pass labels= explicitly")
        labels = got
    return cells.groupBy(BUCKET).pivot(LABEL, list(labels)).agg(F.first(value)).na.fill(0)
