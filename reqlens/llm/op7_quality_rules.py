"""Quality rules with adaptive thresholds (operator 7, native).

Metrics come from DataFrame expressions over each whole text.  Every metric's
upper fence is read from mergeable KLL quantile sketches kept per (lang,
source); the sketches of a language are merged from those of its sources and
serve where a source has too few documents.  Fences are joined back and decide.
No Python runs on the executors.

Defined cases: null and blank texts have no words (all metrics 0) and fail the
base rule; null ``lang`` or ``source`` is a group of its own; repeated rows are
judged alike; an empty table gives an empty table; extra columns are ignored by
the query and kept by :func:`filter_quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import SPACES, land, word_list

#: ratio metrics that get an adaptive upper fence
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "pipe_ratio")
#: a fence is the median plus FENCE times the spread (q90 - q50)
FENCE = 8.0
#: what a ratio counts, what it is a share of, and how many of them beyond the fence are too few to judge by
COUNTED = {"symbol_ratio": ("n_symbols", "word_chars", 4), "dup_line_ratio": ("n_dup_lines", "n_lines", 3),
           "repeat_ratio": ("n_repeat_words", "n_words", 12), "upper_ratio": ("n_upper", "word_chars", 8),
           "pipe_ratio": ("n_pipes", "n_words", 3)}
#: q90 is held to be junk where q90 - q50 is more than JUNK times q75 - q50, more than q50 - q10 and more than a few
JUNK = 3.0
#: a (lang, source) group with fewer documents uses its language's sketch
MIN_GROUP = 200
SKETCH_K = 400
#: repeated windows of a text up to which each is looked up (both ways give the same positions)
FEW = 48


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: it is bound as a
    lambda variable instead of being copied into every inner expression."""
    return F.transform(F.array(value), body)[0]


def _word_counts(words: Column) -> Column:
    """n_words, word_chars, and n_repeat_words: words covered by 3-word windows
    that occur at least twice in the text.

    Windows are compared by 64-bit hashes.  Where some hash is not distinct,
    the positions of repeated ones are found, in order; the union of [p, p+2]
    over them is a sum of gaps clipped at 3."""
    def body(w):
        n = F.size(w)
        at = F.sequence(F.lit(0), n - 3)
        hashes = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def repeats(h):
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                _let(_let(_let(F.sort_array(h), twice), lambda d: places(h, d)), covered))

        def twice(s):
            return F.array_distinct(F.transform(
                F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1)), lambda i: F.get(s, i)))

        def places(h, d):
            # a few repeated hashes are looked up one by one; many (a long text repeated) are sorted
            found = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, F.get(h, i)))
            ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
            return F.when(F.size(d) <= FEW, found).otherwise(_let(ordered, repeated))

        def repeated(a):
            m = F.size(a)
            same = lambda i, j: F.coalesce(F.get(a, i)["h"] == F.get(a, j)["h"], F.lit(False))
            idx = F.filter(F.sequence(F.lit(0), m - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            return F.sort_array(F.transform(idx, lambda i: F.get(a, i)["p"]))

        def covered(p):
            gaps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.least(F.get(p, i) - F.get(p, i - 1), F.lit(3)))
            return F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)

        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        F.when(n < 3, F.lit(0)).otherwise(_let(hashes, repeats)).cast("long").alias("n_repeat_words"))
    return _let(words, body)


def document_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus word_chars, n_words, n_lines, n_symbols, n_dup_lines,
    n_repeat_words, n_upper, n_pipes and the ratio metrics."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({
        "__counts": _word_counts(word_list(F.col(text))),
        "__lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"),
                                                  (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "__symbols": F.regexp_replace(t, r"[^#*$%&|<>]+", ""),
        "__upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
    })
    out = out.withColumns({
        **{k: F.col(f"__counts.{k}") for k in ("n_words", "word_chars", "n_repeat_words")},
        "n_symbols": F.octet_length("__symbols").cast("long"),
        "n_dup_lines": F.col("__lines.dup"),
        "n_lines": F.col("__lines.n").cast("long"),
        "n_upper": F.col("__upper").cast("long"),
        "n_pipes": (F.octet_length("__symbols") - F.octet_length(F.replace("__symbols", F.lit("|")))).cast("long"),
    })
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return out.withColumns({
        **{m: per(*COUNTED[m][:2]) for m in RATIOS},
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }).drop("__counts", "__lines", "__symbols", "__upper")


def adaptive_fences(metrics: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE, junk: float = JUNK) -> DataFrame:
    """One row per (lang, source) with an upper fence ``hi_<metric>`` each."""
    sizes = sorted({of for _, of, _ in COUNTED.values()})
    by_source = metrics.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"n_{c}") for c in sizes],
        *[F.kll_sketch_agg_double(m, SKETCH_K).alias(f"s_{m}") for m in RATIOS])
    by_lang = by_source.groupBy("lang").agg(
        F.sum("n").alias("n_lang"), *[F.sum(f"n_{c}").alias(f"l_{c}") for c in sizes],
        *[F.kll_merge_agg_double(f"s_{m}", SKETCH_K).alias(f"l_{m}") for m in RATIOS])
    both = by_source.alias("a").join(by_lang.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")))
    cols = [F.col("a.lang").alias("lang"), F.col("a.source").alias("source")]
    for m in RATIOS:
        _, of, few = COUNTED[m]
        own = F.col("n") >= min_group
        s = F.when(own, F.col(f"s_{m}")).otherwise(F.col(f"l_{m}"))
        size = F.when(own, F.try_divide(F.col(f"n_{of}"), F.col("n"))).otherwise(F.try_divide(F.col(f"l_{of}"), F.col("n_lang")))
        q10, q50, q75, q90 = (F.kll_sketch_get_quantile_double(s, F.lit(q)) for q in (0.1, 0.5, 0.75, 0.9))
        # junk may hold the upper tail: q90 counts as far as the quartile, the lower tail or a few in a mean text bear it out
        borne = F.greatest(F.lit(junk) * (q75 - q50), q50 - q10, F.coalesce(F.try_divide(F.lit(float(few)), size), F.lit(0.0)))
        cols.append((q50 + F.lit(fence) * F.least(q90 - q50, borne)).alias(f"hi_{m}"))
    return both.select(*cols)


def apply_fences(metrics: DataFrame, fences: DataFrame) -> DataFrame:
    """``metrics`` plus ``kept``: neither failed by the base rule nor beyond a
    fence of its group by more than a few symbols, lines or words."""
    f = fences.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    joined = metrics.join(f, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    within = F.lit(True)
    for m in RATIOS:
        count, of, few = COUNTED[m]
        within = within & F.coalesce(F.col(count) - F.col(f"hi_{m}") * F.col(of) <= few, F.lit(True))
    return (joined.withColumn("kept", ~F.col("base_failed") & within)
            .drop("__lang", "__source", *[f"hi_{m}" for m in RATIOS]))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that pass, with their own columns only."""
    own = docs.columns
    m = land(document_metrics(docs, text), "quality-metrics")
    return apply_fences(m, adaptive_fences(m)).where("kept").select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    from reqlens.llm.common import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    m = land(document_metrics(docs).drop("text"), "quality-metrics")
    return apply_fences(m, adaptive_fences(m)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
