"""URL expressions: query stripping, URI-pattern generalisation, pattern rules.

All of these return native ``Column`` expressions (``transform`` with an index
lambda, ``rlike``, ``CASE``), so they stay inside whole-stage codegen and never
leave the JVM.  Rule chains are plan literals: a rule list is small by nature
(it is the output of a top-N), and its size is checked before it is inlined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Static-file categories by lower-cased extension (10 categories,
# 59 extensions).  They must equal the reference's table for equal results.
# ---------------------------------------------------------------------------
STATIC_FILE_CATEGORIES: dict[str, tuple[str, ...]] = {
    "*.css": ("css", "scss", "sass", "less"),
    "*.js": ("js", "jsx", "ts", "tsx", "mjs", "cjs"),
    "*.image": ("png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "bmp", "tif", "tiff"),
    "*.font": ("woff", "woff2", "ttf", "otf", "eot"),
    "*.doc": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx"),
    "*.video": ("mp4", "avi", "mov", "webm", "mkv", "flv", "wmv"),
    "*.audio": ("mp3", "wav", "ogg", "m4a", "flac", "aac"),
    "*.html": ("html", "htm"),
    "*.data": ("json", "xml", "yaml", "yml", "csv", "txt"),
    "*.archive": ("zip", "tar", "gz", "rar", "7z", "bz2"),
}
# Id-like segment tests (all digits; UUID; >= 16 hex; long and
# > 70 % digits).
UUID_REGEX = "^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LONG_HEX_REGEX = "^(?i)[0-9a-f]{16,}$"
DIGIT_SHARE = 0.7
DIGIT_SHARE_MIN_LEN = 8
# Rows whose URL is missing carry this label in every top-N series.
UNKNOWN = "Unknown"
OTHERS = "Others"


def strip_query(url: Column) -> Column:
    """The part before the first ``?`` (null stays null)."""
    return F.substring_index(url, "?", 1)


def static_category(segment: Column) -> Column:
    """``*.css`` … ``*.archive`` for a file-like segment, else null."""
    ext = F.lower(F.substring_index(segment, ".", -1))
    expr = None
    for label, exts in STATIC_FILE_CATEGORIES.items():
        expr = (F.when(ext.isin(*exts), F.lit(label)) if expr is None
                else expr.when(ext.isin(*exts), F.lit(label)))
    return F.when(segment.contains("."), expr)


ID_REGEX = "^(?:[0-9]+|(?i:" + UUID_REGEX[5:-1] + ")|(?i:" + LONG_HEX_REGEX[5:-1] + "))$"


def is_id_like(segment: Column) -> Column:
    """All ASCII digits, a UUID, a long hex string, or mostly digits.

    One combined regex for the first three tests; the digit share counts
    digits with ``translate`` (no regex).
    """
    n = F.length(segment)
    digits = n - F.length(F.translate(segment, "0123456789", ""))
    return segment.rlike(ID_REGEX) | ((n > DIGIT_SHARE_MIN_LEN) & (digits / n > DIGIT_SHARE))


def generalize_url(url: Column) -> Column:
    """Default URI pattern of a URL.

    The text before the first ``?`` is split on ``/``; the last non-empty
    segment may become a static-file category, any other id-like segment
    becomes ``*``; ``?*`` is appended when the URL had a query.  Empty and
    null URLs are returned unchanged.  The static-file test runs once per
    URL (on the last segment), outside the per-segment lambda.
    """
    segs = F.split(strip_query(url), "/", -1)
    last = F.size(segs) - 1
    last_cat = static_category(F.element_at(segs, -1))

    def one(x: Column, i: Column) -> Column:
        return (F.when(x == "", x)
                .when((i == last) & last_cat.isNotNull(), last_cat)
                .when(is_id_like(x), F.lit("*"))
                .otherwise(x))

    body = F.concat(F.array_join(F.transform(segs, one), "/"),
                    F.when(url.contains("?"), F.lit("?*")).otherwise(F.lit("")))
    return F.when(url.isNull() | (url == ""), url).otherwise(body)


# ---------------------------------------------------------------------------
# Pattern rules
# ---------------------------------------------------------------------------
MAX_INLINE_RULES = 5000


@dataclass(frozen=True)
class Rule:
    pattern: str       # a Python/Java regex, matched at the start of the URL
    replacement: str


def wildcard_to_regex(pattern: str) -> str:
    """``/api/*/items`` → ``^/api/.*/items$`` (everything but ``*`` literal)."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def rules_from_patterns(patterns: list[str]) -> list[Rule]:
    """A URI-pattern (or URL) list as literal rules, in order."""
    return [Rule(wildcard_to_regex(p), p) for p in patterns if p]


def _start_anchored(regex: str) -> str:
    # Python's re.match anchors at the start only; rlike searches anywhere.
    return f"^(?:{regex})"


def rule_label(url: Column, rules: list[Rule]) -> Column | None:
    """First matching rule's replacement (null when none matches)."""
    if not rules:
        return None
    if len(rules) > MAX_INLINE_RULES:
        raise ValueError(f"{len(rules)} rules exceed the inline limit {MAX_INLINE_RULES}")
    expr = None
    for r in rules:
        cond = url.rlike(_start_anchored(r.pattern))
        expr = F.when(cond, F.lit(r.replacement)) if expr is None else expr.when(cond, F.lit(r.replacement))
    return expr


def generalize_with_rules(url: Column, rules: list[Rule] | None = None) -> Column:
    """P5: first matching rule wins, else the default generalisation."""
    lab = rule_label(url, rules or [])
    base = generalize_url(url)
    if lab is None:
        return base
    return F.when(url.isNull() | (url == ""), url).otherwise(F.coalesce(lab, base))


def url_pattern_label(url: Column, rules: list[Rule] | None = None) -> Column:
    """Series label of a URL: P5, with a missing URL labelled ``Unknown``."""
    return F.when(url.isNull(), F.lit(UNKNOWN)).otherwise(generalize_with_rules(url, rules))


def scatter_label(url: Column, rules: list[Rule] | None = None,
                  max_len: int = 50, keep: int = 47) -> Column:
    """Rule replacement, else the URL cut to ``keep`` chars + ``...``."""
    cut = F.when(F.length(url) > max_len, F.concat(F.substring(url, 1, keep), F.lit("..."))).otherwise(url)
    lab = rule_label(url, rules or [])
    body = cut if lab is None else F.coalesce(lab, cut)
    return F.when(url.isNull(), F.lit(UNKNOWN)).otherwise(body)


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    """Rules as a DataFrame ``(ord, pattern, replacement)``."""
    return spark.createDataFrame([(i, r.pattern, r.replacement) for i, r in enumerate(rules)],
                                 "ord INT, pattern STRING, replacement STRING")


def collect_rules(rules_df: DataFrame, limit: int = MAX_INLINE_RULES) -> list[Rule]:
    """Bring a (small, size-checked) rule table to the driver in ``ord`` order."""
    rows = rules_df.select("ord", "pattern", "replacement").orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rules")
    return [Rule(r["pattern"], r["replacement"]) for r in rows]
