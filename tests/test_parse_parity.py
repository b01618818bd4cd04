"""Spark's one-pass parse vs Python ``re.match`` on generated lines (brute force)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from reqlens.sources import formats as FM
from reqlens.sources import text as TX

token = st.text(alphabet='ab1-. :"[]/', min_size=0, max_size=6)
word = st.text(alphabet="abcXYZ019./-", min_size=1, max_size=8)
num = st.integers(min_value=0, max_value=999).map(str)


def httpd_line():
    return st.builds(
        lambda ip, user, day, req, status, size, tail, junk:
        f'{ip} - {user} [{day}/Jan/2024:10:00:00 +0900] "{req}" {status} {size}{tail}{junk}',
        word, st.one_of(st.just("-"), word), st.integers(1, 28).map(lambda d: f"{d:02d}"),
        st.one_of(st.just("-"), st.builds(lambda m, u: f"{m} {u} HTTP/1.1", st.sampled_from(["GET", "POST"]), word),
                  word),
        st.one_of(num, st.just("-")), st.one_of(num, st.just("-")),
        st.one_of(st.just(""), st.builds(lambda r, a: f' "{r}" "{a}"', word, word)), token)


def py_parse(line, fmt):
    line = line.strip()
    m = re.match(fmt.pattern, line) if line else None
    if not m:
        return None
    g = m.groups()
    rec = {c: (None if i >= len(g) or g[i] in ("", "-", " ", None) else g[i]) for i, c in enumerate(fmt.columns)}
    if not (rec.get("time") or rec.get("status")):
        return None
    return rec


@settings(max_examples=15, deadline=None)
@given(st.lists(httpd_line(), min_size=1, max_size=25))
def test_httpd_raw_groups_match_python(spark, lines):
    fmt = FM.preset("httpd")
    raw = FM.LogFormat("raw", fmt.pattern, fmt.columns, {}, "HTTPD")   # untyped: compare raw groups
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id INT, value STRING")
    got = {r["id"]: {c: r[c] for c in fmt.columns} for r in TX.parse_lines(df, raw).records.collect()}
    want = {i: rec for i, x in enumerate(lines) if (rec := py_parse(x, fmt)) is not None}
    assert got == want
