"""Operator 13 against brute force; its query against SQL is in test_sql.py."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from reqlens.llm import op13_prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + x[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in sorted(built.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
        ends[tuple(x)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        if p not in children:
            leaves[p] = 1
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode())
            up = p[:-1]
            children[up] += 1
            leaves[up] += leaves[p]
            saved[up] += saved[p]
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members)


def got(df, **kw):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in trie.prefix_trie(df, **kw).select(cols).collect())


@pytest.fixture(scope="module")
def talks():
    """Branching conversations from a small alphabet, many copies of one, a
    very long one with branches, and one that leaves it a turn later each."""
    rnd = random.Random(6)
    turn = lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "longer text"]))
    talks = {c: [turn() for _ in range(rnd.randrange(1, 12))] for c in range(-20, 90) if c % 7}
    long = [turn() for _ in range(160)]
    talks |= {1000 + 5 * k: talks[1] for k in range(30)} | {2000: long, 2001: long[:90] + [("user", "off")] * 60}
    talks |= {3000 + 5 * k: long[:4 * k] + [("user", "x")] for k in range(20)}
    rows = [(c, i if c % 3 else i // 2, *t, "k", "k") for c, x in talks.items() for i, t in enumerate(x)]
    rows += rows[:9] + [(None, 0, "user", "hi", "k", "k"), (4001, None, "user", "first", "k", "k"), (4001, 0, "user", "second", "k", "k")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("kw", [{}, {"shard": 16, "queue": 3}])
def test_equals_brute_force(spark, talks, kw):
    assert got(spark.createDataFrame(talks, SCHEMA).repartition(4), **kw) == brute(talks)


def test_empty_and_one_row(spark):
    one = [(7, None, None, None, "k", "k")]
    df = spark.createDataFrame(one, SCHEMA)
    assert got(df) == brute(one)
    assert got(df.limit(0)) == []


def test_queue_spills_in_order():
    rnd = random.Random(2)
    queue, kept = trie.SpillingQueue(5), []
    for _ in range(400):
        if kept and rnd.random() < 0.4:
            kept.sort()
            assert queue.least() == kept[0] and queue.pop() == kept.pop(0)
        else:
            kept.append((rnd.randrange(50), rnd.randrange(10**6)))
            queue.push(kept[-1])
    assert queue.spilled > 50
    assert [queue.pop() for _ in kept] == sorted(kept) and queue.least() is None


def test_fingerprints_compose():
    x = [random.Random(1).randrange(trie._P) for _ in range(9)]

    def fp(seq):
        f = 0
        for t in seq:
            f = trie._join(f, t, 1)
        return f
    assert all(trie._join(fp(x[:k]), fp(x[k:]), 9 - k) == fp(x) for k in range(10))
