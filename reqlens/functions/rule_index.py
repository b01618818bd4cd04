"""Pattern rules at any count (P5, T7, F6, F7): a join instead of a CASE chain.

A rule is a regex matched at the start of a URL; the rule of least number wins.
Every text that a rule matches must hold the literal parts of its regex, so
each rule is posted under one *key*: a prefix of a quantised length, or a
short gram from one of its literal runs, whichever the fewest rules share.  A
URL is looked up by its own prefixes and grams (an equi-join), the few
rules found are checked by their whole regex, and the least number is kept.
Rules without any literal (``.*``, ``(?i)...``) are tested one by one.

The work is per distinct URL; the rules are plan-time metadata.  Results equal
``urls.rule_label``, which stays the way for short lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from re import _parser as _regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.functions.urls import Rule, generalize_url, rule_label

#: rules up to which one CASE chain is shorter than the join
FEW = 200
#: lengths of prefix keys and of gram keys
PREFIXES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
GRAMS = (3, 6, 12)


def literal_runs(pattern: str) -> tuple[str, list[str]]:
    """The literal prefix of a regex and all runs of literal characters that
    every match holds."""
    try:
        parsed = _regex.parse(pattern)
    except re.error:                      # valid for Java only: no key
        return "", []
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return "", []
    runs = [""]

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "AT":
                pass
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
                runs[-1] += chr(arg[2][0][1])
                if arg[:2] != (1, 1):
                    runs.append("")
            else:
                runs.append("")
    walk(parsed)
    return runs[0], [r for r in runs if r]


def candidate_keys(pattern: str) -> set[str]:
    prefix, runs = literal_runs(pattern)
    keys = {f"p{n}:{prefix[:n]}" for n in [max((n for n in PREFIXES if n <= len(prefix)), default=0)] if n}
    for run in runs:
        for n in GRAMS:
            if n <= len(run):
                keys |= {f"g{n}:{run[:n]}", f"g{n}:{run[-n:]}"}
    return keys


def rule_keys(rules: Sequence[Rule]) -> list[str | None]:
    """The key of each rule, or None for a rule without a literal part."""
    found = [candidate_keys(r.pattern) for r in rules]
    shared = Counter(k for keys in found for k in keys)
    return [min(keys, key=lambda k: (shared[k], -len(k), k), default=None) for keys in found]


def _url_keys(url: Column, used: set[str]) -> Column:
    parts = [F.array(F.concat(F.lit(f"p{n}:"), F.left(url, F.lit(n)))) for n in PREFIXES if f"p{n}" in used]

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(url) - n + 1)
        return F.transform(at, lambda i: F.concat(F.lit(f"g{n}:"), F.substring(url, i, F.lit(n))))
    for n in GRAMS:
        if f"g{n}" in used:
            parts.append(F.when(F.length(url) >= n, grams(n)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def with_rule(urls: DataFrame, url: str, rules: Sequence[Rule], name: str) -> DataFrame:
    """Add the replacement of the first matching rule (null: none) to a table
    whose ``url`` values are distinct."""
    rules = list(rules)
    if len(rules) <= FEW:
        return urls.withColumn(name, rule_label(F.col(url), rules) if rules else F.lit(None).cast("string"))
    keys = rule_keys(rules)
    spark = urls.sparkSession
    posted = [(k, i, f"^(?:{r.pattern})", r.replacement) for i, (r, k) in enumerate(zip(rules, keys)) if k is not None]
    index = spark.createDataFrame(posted, "__key STRING, __ord INT, __pattern STRING, __rep STRING")
    used = {k.split(":", 1)[0] for k, *_ in posted}
    best = F.struct(F.col("__ord").alias("ord"), F.col("__rep").alias("rep"))
    if posted:
        looked = urls.select(F.col(url).alias("__u")).where("__u IS NOT NULL")
        hits = (looked.select("__u", F.explode(_url_keys(F.col("__u"), used)).alias("__key")).join(index, "__key")
                .where(F.rlike(F.col("__u"), F.col("__pattern"))).groupBy("__u").agg(F.min(best).alias("__hit")))
        urls = urls.join(hits, F.col(url) == F.col("__u"), "left").drop("__u")
    else:
        urls = urls.withColumn("__hit", F.lit(None).cast("struct<ord:int,rep:string>"))
    free = [(i, r) for i, (r, k) in enumerate(zip(rules, keys)) if k is None]
    for at in range(0, len(free), max(FEW, 1)):
        chain = None
        for i, r in free[at:at + max(FEW, 1)]:
            hit = F.col(url).rlike(f"^(?:{r.pattern})")
            value = F.struct(F.lit(i).alias("ord"), F.lit(r.replacement).alias("rep"))
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        urls = urls.withColumn("__hit", F.least(F.col("__hit"), chain))
    return urls.withColumn(name, F.col("__hit.rep")).drop("__hit")


def with_pattern(urls: DataFrame, url: str, rules: Sequence[Rule] | None, name: str) -> DataFrame:
    """P5 over a table of distinct URLs: the first matching rule's
    replacement, else the default generalisation."""
    if not rules:
        return urls.withColumn(name, generalize_url(F.col(url)))
    u = F.col(url)
    return (with_rule(urls, url, rules, "__rule")
            .withColumn(name, F.when(u.isNull() | (u == ""), u).otherwise(F.coalesce("__rule", generalize_url(u)))).drop("__rule"))


def keep_matching(df: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows whose URL any rule matches, through the distinct URLs."""
    hit = with_rule(df.select(F.col(url).alias("__url")).where("__url IS NOT NULL").distinct(), "__url", rules, "__rule")
    return df.join(hit.where("__rule IS NOT NULL").select("__url"), F.col(url) == F.col("__url"), "left_semi")
