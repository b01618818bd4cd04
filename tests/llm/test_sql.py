"""Queries of the training-data operators that SQL can express, against SQL."""

import math

import pytest

from reqlens.llm.queries import ORACLES, QUERIES


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    cols = sorted(found.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in found.collect()), key=str) == sorted(want, key=str)
