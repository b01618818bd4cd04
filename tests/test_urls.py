"""URL generalisation checked against a plain-Python statement of the rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reqlens.functions import urls as U

_CATS = {ext: label for label, exts in U.STATIC_FILE_CATEGORIES.items() for ext in exts}


def py_generalize(url):
    if not url:
        return url
    path = url.split("?")[0]
    segs = path.split("/")
    out = []
    for i, s in enumerate(segs):
        if not s:
            out.append(s)
            continue
        if i == len(segs) - 1 and "." in s and s.rsplit(".", 1)[-1].lower() in _CATS:
            out.append(_CATS[s.rsplit(".", 1)[-1].lower()])
            continue
        digits = sum(c in "0123456789" for c in s)
        idlike = (re.fullmatch(r"[0-9]+", s) or re.fullmatch(U.UUID_REGEX[5:-1], s, re.I)
                  or re.fullmatch(r"[0-9a-f]{16,}", s, re.I) or (len(s) > 8 and digits / len(s) > 0.7))
        out.append("*" if idlike else s)
    res = "/".join(out)
    return res + "?*" if "?" in url else res


CASES = [
    "/api/users/12345/orders", "/static/css/main.CSS", "/img/logo.png?v=3", "/a/b/",
    "https://host.example.com/en/825?page=2", "/users/550e8400-e29b-41d4-a716-446655440000/x",
    "/files/deadbeefdeadbeef0/", "/o/A123456789", "/o/A12345678x", "/report.2024.pdf", "", None,
    "/x/.htaccess", "/x/archive.tar.gz", "12345", "/v1/abc12345678/def", "/a//b", "?q=1",
]


def test_generalize_cases(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u STRING")
    got = [r[0] for r in df.select(U.generalize_url(F.col("u"))).collect()]
    assert got == [py_generalize(u) for u in CASES]


segment = st.one_of(
    st.from_regex(r"[0-9]{1,12}", fullmatch=True),
    st.from_regex(r"[0-9a-fA-F]{14,20}", fullmatch=True),
    st.from_regex(r"[a-z]{1,6}[0-9]{0,9}", fullmatch=True),
    st.from_regex(r"[a-zA-Z0-9_-]{1,8}\.(png|JS|html|xyz|tar|gz|Json)", fullmatch=True),
    st.just(""),
)
url_strategy = st.builds(lambda segs, q: "/".join(segs) + ("?a=1" if q else ""),
                         st.lists(segment, min_size=1, max_size=6), st.booleans())


@settings(max_examples=25, deadline=None)
@given(st.lists(url_strategy, min_size=1, max_size=40))
def test_generalize_property(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    got = [r[0] for r in df.select(U.generalize_url(F.col("u"))).collect()]
    assert got == [py_generalize(u) for u in urls]


def test_rules_first_match_and_wildcards(spark):
    rules = U.rules_from_patterns(["/api/*/items", "/api/*"])
    assert rules[0].pattern == "^/api/.*/items$"
    df = spark.createDataFrame([("/api/7/items",), ("/api/7",), ("/other/9",), (None,)], "u STRING")
    got = [r[0] for r in df.select(U.url_pattern_label(F.col("u"), rules)).collect()]
    assert got == ["/api/*/items", "/api/*", "/other/*", "Unknown"]


def test_rule_regex_is_start_anchored_only(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/x/a/b",)], "u STRING")
    got = [r[0] for r in df.select(U.rule_label(F.col("u"), [U.Rule("/a/b", "AB")])).collect()]
    assert got == ["AB", None]


def test_scatter_label(spark):
    long = "/" + "x" * 60
    df = spark.createDataFrame([(long,), ("/short",), (None,)], "u STRING")
    got = [r[0] for r in df.select(U.scatter_label(F.col("u"))).collect()]
    assert got == [long[:47] + "...", "/short", "Unknown"]
