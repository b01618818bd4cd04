"""Operator 11 against brute force; its query against SQL is in test_sql.py."""

import random
import re

import numpy as np
import pytest

from reqlens.llm import op11_substring_dedup as sub

W = sub.WINDOW


def brute(rows):
    """(doc_id, n_words, n_removed, kept text) of every (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - W + 1 if i is not None else 0):
            s = tuple(w[p:p + W])
            least[s] = min(least.get(s, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - W + 1 if i is not None else 0):
            if least[tuple(w[p:p + W])] < i:
                gone |= set(range(p, p + W))
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in sub.remove_repeats(df, **kw).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


@pytest.fixture(scope="module")
def passages(spark):
    """Random texts with shared passages of 12 to 40 words, copies, repeats
    inside a text, one doc_id on several rows, and no id at all."""
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(400))
    shared = [[word() for _ in range(rnd.randrange(12, 41))] for _ in range(12)]
    rows = []
    for i in range(300):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(shared)
        rows.append((rnd.choice([i, i, i, i // 3, None]), " ".join(w)))
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, "same " * 60), (2001, "same " * 13), (2002, "same " * 12)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 700, "range_bits": 6}])
def test_equals_brute_force(spark, passages, kw):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    assert got(df, **kw) == brute(passages)


def test_sketch_never_undercounts(spark, passages):
    """Every window that two documents hold is estimated repeated, and the
    estimate adds few others."""
    blocks = sub.pack(spark.createDataFrame(passages, "doc_id long, text string").coalesce(2), 4000).collect()
    held = {}
    for b in blocks:
        w = sub.Windows(b["ids"], bytes(b["words"]))
        for e, i in zip(w.entry.tolist(), w.id.tolist()):
            held.setdefault(int(w.hashes[e]), set()).add(i)
    total = sum(b["windows"] for b in blocks)
    bits = (sub.CELLS * total - 1).bit_length()
    df = spark.createDataFrame(blocks, sub.BLOCK)
    replies = sub.merge_sketches(sub.partition_sketches(df, bits, 6), 6)
    repeated = set()
    for b in sub._with_replies(df, replies, "sketch", "row", "range").collect():
        w = sub.Windows(b["ids"], bytes(b["words"]))
        repeated |= set(w.hashes[sub._estimated(w, b["sketch"], bits, 6)].tolist())
    true = {h for h, docs in held.items() if len(docs) > 1}
    assert true <= repeated and len(repeated - true) < 0.15 * len(held)


def test_cells_survive_packing():
    cells = np.unique(np.random.default_rng(1).integers(0, 1 << 21, 5000).astype(np.uint64))
    assert (sub._unpack_cells(sub._pack_cells(cells)) == cells.astype(np.int64)).all()


def test_word_hashes_tell_words_apart():
    """Equal words hash alike wherever they stand, others (prefixes, long
    words, zero bytes) apart."""
    words = [b"a" * k for k in range(1, 40)] + [b"abcdefgh", b"abcdefgh\0", b"x" * 300, b"x" * 301, "é".encode() * 9]
    text = b" ".join(words * 2)
    size = np.array([len(w) for w in words] * 2)
    h = sub.hash_lanes(np.frombuffer(text, np.uint8), np.cumsum(size + 1) - size - 1, size)
    assert (h[:len(words)] == h[len(words):]).all() and len(set(h.tolist())) == len(words)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert sub.remove_repeats(none).count() == 0
