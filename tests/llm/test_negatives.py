"""Operator 12 against brute force; its query against SQL is in test_sql.py."""

import math
import random

import numpy as np
import pytest

from reqlens.llm import op12_hard_negatives as neg

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block string"


def brute(rows):
    v = []
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if math.fmod(i, 7) == 0:
            label = int(math.fmod(label + 1, 10))
        v.append((i, [math.floor(256 * c) for c in x], label))
    out = []
    for i, x, label in v:
        if math.fmod(i, 100):
            continue
        s = sorted((-sum(a * b for a, b in zip(x, y)), j, k) for j, y, k in v)
        for p, j, _ in [t for t in s if t[2] == label and t[1] != i][:5]:
            fit = [(q, n) for q, n, k in s if k != label and 80 * -p <= 100 * -q <= 100 * -p][:5]
            out += [(i, j, rank, n, -p, -q) for rank, (q, n) in enumerate(fit, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in neg.mine(df, **kw).collect())


def vectors(n, dim, near, seed=0):
    """Clustered unit vectors, ``near`` of them copies of others, all labels."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((8, dim))[rng.integers(0, 8, n)] + 0.5 * rng.standard_normal((n, dim))
    x[rng.integers(0, n, near)] = x[rng.integers(0, n, near)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i) - 300, v.tolist(), int(k), "x", "y") for i, (v, k) in enumerate(zip(x, rng.integers(0, 10, n)))]


@pytest.mark.parametrize("kw", [{}, {"rows": 64, "anchors": 4}])
def test_equals_brute_force(spark, kw):
    rows = vectors(1500, 12, 200)
    random.Random(1).shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6), **kw) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(420, 6, 30)
    i = lambda k: rows[300 + k]  # noqa: E731  vec_id k
    rows += [(100, i(100)[1], 3, "x", "y")] * 2 + [i(5), i(5)]
    rows += [(None, [1.0] * 6, 1, "x", "y"), (1000, None, 1, "x", "y"), (1100, [1.0, None], 1, "x", "y"), (1200, [math.nan] * 6, 1, "x", "y"),
             (1300, [math.inf] * 6, 1, "x", "y"), (1400, [1.0] * 6, None, "x", "y"), (1500, [], 2, "x", "y"), (1601, [0.5], 2, "x", "y"),
             (1600, [0.25] * 9, 2, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id % 100 <> 0")) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(1 << 21)) + rng.random() for _ in range(4)], i % 3, "x", "y") for i in range(120)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def _block(x, ids, labels):
    return neg.Block({"ids": np.asarray(ids, "<i8").tobytes(), "labels": np.asarray(labels, "<i8").tobytes(),
                      "vectors": np.asarray(x, "<f8").tobytes(), "kind": "<f8", "n": len(x)})


def test_tree_bounds_hold_and_spare_scores():
    """Intervals hold every true score; anchors near each other leave most
    rows unscored."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 32)) * 60
    a = np.floor(base[rng.integers(0, 3, 60)] + rng.standard_normal((60, 32)))
    c = np.floor(rng.standard_normal((2000, 32)) * 40)
    anchors, rows = _block(a, range(60), [0] * 60), _block(c, range(1000, 3000), [1] * 2000)
    tree = neg.spanning_tree(a)
    order, parent, edge = tree
    assert sorted(order.tolist()) == list(range(60)) and (parent == -1).sum() == 1
    assert all(np.isclose(edge[k], np.linalg.norm(a[k] - a[parent[k]])) for k in order[1:])
    b, true = neg.Bounds(anchors, tree, rows), c @ a.T
    for k in order.tolist():
        low, high = b.at(k)
        assert (low <= true[:, k]).all() and (true[:, k] <= high).all()
        wanted = np.flatnonzero((high >= 9000) & (low <= 12000))
        b.settle(k, wanted, b.score(k, wanted))
    assert b.scored < 0.5 * true.size and not b.low
