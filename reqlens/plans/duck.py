"""DuckDB text builders for oracle queries (URL generalisation, buckets).

These mirror the Spark expressions in ``reqlens.functions`` with DuckDB's own
functions (1-based list lambdas, RE2 regexes), so the oracle is an
independent statement of the same semantics.
"""

from __future__ import annotations

from reqlens.functions.urls import LONG_HEX_REGEX, STATIC_FILE_CATEGORIES, UUID_REGEX


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def static_category(x: str) -> str:
    ext = f"lower(regexp_extract({x}, '\\.([^.]*)$', 1))"
    whens = " ".join(
        f"WHEN {ext} IN ({', '.join(sql_str(e) for e in exts)}) THEN {sql_str(label)}"
        for label, exts in STATIC_FILE_CATEGORIES.items())
    return f"(CASE WHEN contains({x}, '.') THEN (CASE {whens} END) END)"


def id_like(x: str) -> str:
    uuid = UUID_REGEX.removeprefix("^").removesuffix("$")
    hexre = LONG_HEX_REGEX.removeprefix("^").removesuffix("$")
    return (f"(regexp_full_match({x}, '[0-9]+') OR regexp_full_match({x}, {sql_str(uuid)}) "
            f"OR regexp_full_match({x}, {sql_str(hexre)}) OR (length({x}) > 8 AND "
            f"length(regexp_replace({x}, '[^0-9]', '', 'g')) / length({x}) > 0.7))")


def generalize_url(u: str) -> str:
    segs = f"string_split(split_part({u}, '?', 1), '/')"
    lam = (f"lambda x, i: CASE WHEN x = '' THEN x "
           f"WHEN i = len({segs}) AND {static_category('x')} IS NOT NULL THEN {static_category('x')} "
           f"WHEN {id_like('x')} THEN '*' ELSE x END")
    body = (f"array_to_string(list_transform({segs}, {lam}), '/') || "
            f"CASE WHEN contains({u}, '?') THEN '?*' ELSE '' END")
    return f"(CASE WHEN {u} IS NULL OR {u} = '' THEN {u} ELSE {body} END)"


def rule_chain(u: str, rules, fallback: str) -> str:
    """First matching rule (start-anchored regex) else ``fallback``."""
    if not rules:
        return fallback
    whens = " ".join(f"WHEN regexp_matches({u}, {sql_str('^(?:' + r.pattern + ')')}) "
                     f"THEN {sql_str(r.replacement)}" for r in rules)
    return f"(CASE {whens} ELSE {fallback} END)"


def bucket(ts: str, interval_sql: str) -> str:
    return f"time_bucket({interval_sql}, {ts}, TIMESTAMP '1970-01-01')"
