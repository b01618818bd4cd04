"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 1).

Texts are compared as lists of normalised words (lower case, ASCII punctuation
as space).  The CGK random walk reads a word list with one pointer; at step j it
emits the word under the pointer and moves on if random bit j of that word's
hash is set, so word edits become few Hamming differences of the emitted
strings.  An LSH key is the hash of a few sampled steps.  ``REPEATS``
independent walks are made from every word of every document and from every
word of every benchmark item; a document position and an item position with
equal keys propose an item-sized window, which the exact word edit distance
then confirms: at most ``EDIT_RATE`` of the item's words may be inserted,
deleted or replaced.

Walks miss some copies, of short items above all, so every item is also split
into one more piece than it may have edits: a copy within the limit holds some
piece unchanged, and the piece's hash proposes the window.  Recall at the edit
limit is thus 1 for items of any length; an item without edits is one piece.
The benchmark is read in blocks of about ``BLOCK_WORDS`` words, each of
which becomes a bounded broadcast; documents are never shuffled.

Defined cases: null and wordless documents and items match nothing; repeated
items and repeated documents are reported once per row; a null id stays null;
empty tables give empty results; extra columns are ignored by the query and
kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import hash_words, mix64, read_table, word_count

EDIT_RATE = 0.15
REPEATS, STEPS = 4, 16
#: sampled steps of each walk
SAMPLED = ((0, 3, 6, 10, 14), (1, 4, 7, 9, 13), (0, 2, 5, 8, 12), (2, 5, 8, 11, 15))
BLOCK_WORDS = 500_000
#: positions walked at once (fits a core's cache)
CHUNK = 1 << 15
_TABLE = bytes(32 if chr(c) in string.punctuation else c for c in range(128)) + bytes(range(128, 256))
_K = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TABLE).split()


hashed = hash_words


def max_edits(n_words: int) -> int:
    return int(n_words * EDIT_RATE)


def walk_hashes(h: np.ndarray, repeat: int) -> np.ndarray:
    """Word hashes that carry the random bits of one repetition, padded so
    that a walk may leave the end."""
    return np.concatenate([mix64(h ^ np.uint64((int(_K) * (repeat + 1)) & (1 << 64) - 1)), np.zeros(STEPS, np.uint64)])


def walk_keys(h: np.ndarray, repeat: int, starts: slice) -> tuple[np.ndarray, np.ndarray]:
    """(LSH key, last word read) of the walk from each of ``starts``."""
    steps = SAMPLED[repeat]
    at = np.arange(starts.start, starts.stop)
    key = np.zeros(len(at), np.uint64)
    for j in range(steps[-1] + 1):
        word = h[at]
        if j in steps:
            key *= _K
            key += word
        if j < steps[-1]:
            at += ((word >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return key, at


def phrase_keys(h: np.ndarray, n: int, key: np.ndarray | None = None, done: int = 0) -> np.ndarray:
    """Hash of each run of n words, from the ``key`` of each run of the first
    ``done`` words if given."""
    size = max(0, len(h) - n + 1)
    key = np.zeros(size, np.uint64) if key is None else key[:size]
    for j in range(done, n):
        key = mix64(key * _K + h[j:j + size])
    return key


def pieces(n_words: int) -> list[tuple[int, int]]:
    """An item's ranges of words, one more than it may have edits."""
    n = max_edits(n_words) + 1
    return [(n_words * i // n, n_words * (i + 1) // n) for i in range(n)]


def nearest(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` with the least edit distance
    to ``item``, the leftmost of equals; None beyond ``most``."""
    prev = [(0, j) for j in range(len(text) + 1)]
    for i, w in enumerate(item, 1):
        row = [(i, 0)]
        for j, x in enumerate(text, 1):
            c, s = prev[j - 1]
            if w != x:
                c += 1
            up, left = prev[j], row[j - 1]
            if up[0] + 1 < c:
                c, s = up[0] + 1, up[1]
            if left[0] + 1 < c:
                c, s = left[0] + 1, left[1]
            row.append((c, s))
        prev = row
    j = min(range(len(prev)), key=lambda j: (prev[j][0], j))
    c, s = prev[j]
    return (c, s, j) if c <= most else None


class Index:
    """LSH tables of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, h) for i, h in ((i, hashed(words_of(t))) for i, t in items) if len(h)]
        self.walks = [self._table([(k, n, o) for n, (_, h) in enumerate(self.items) if max_edits(len(h))
                                   for k, o in self._item_keys(h, r)]) for r in range(REPEATS)]
        rows: dict[int, list] = {}
        for n, (_, h) in enumerate(self.items):
            for a, b in pieces(len(h)):
                rows.setdefault(b - a, []).append((int(phrase_keys(h[a:b], b - a)[0]), n, a))
        self.phrases = {m: self._table(rows[m]) for m in sorted(rows)}

    @staticmethod
    def _item_keys(h: np.ndarray, r: int) -> list[tuple[int, int]]:
        key, last = walk_keys(walk_hashes(h, r), r, slice(0, len(h)))
        return [(k, o) for o, k in enumerate(key.tolist()) if last[o] < len(h)]

    @staticmethod
    def _table(rows: list) -> tuple:
        rows.sort()
        keys = np.array([k for k, _, _ in rows], np.uint64)
        bits = np.zeros(1 << 20, bool)      # most positions are turned away here
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        return keys, np.array([n for _, n, _ in rows], np.int64), np.array([o for _, _, o in rows], np.int64), bits

    @staticmethod
    def _hits(table: tuple, key: np.ndarray, base: int) -> list[tuple[int, int, int]]:
        keys, item, offset, bits = table
        maybe = np.flatnonzero(bits[(key >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return []
        lo, hi = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
        return [(base + int(p), int(item[x]), int(offset[x])) for p, a, b in zip(maybe, lo, hi) for x in range(a, b)]

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(word position, item, item position) with equal keys."""
        found = []
        for r, table in enumerate(self.walks):
            if len(table[0]):
                g = walk_hashes(h, r)
                for s in range(0, len(h), CHUNK):
                    key, _ = walk_keys(g, r, slice(s, min(s + CHUNK, len(h))))
                    found += self._hits(table, key, s)
        done, key = 0, np.zeros(len(h), np.uint64)
        for m, table in self.phrases.items():           # ascending: a run's hash goes on from that of the shorter one
            key = phrase_keys(h, m, key, done)
            found += self._hits(table, key, 0)
            done = m
        return found

    def search(self, docs: list[np.ndarray]) -> list[list[tuple[int | None, int, int, int, int]]]:
        """Per document: (item id, first word, end word, edits, item words) of
        the best window of every item within its edit limit."""
        start = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        out: list[list] = [[] for _ in docs]
        h = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        aligned: dict[tuple[int, int], set[int]] = {}
        for p, item, o in self.candidates(h):
            d = int(np.searchsorted(start, p, "right")) - 1
            aligned.setdefault((d, item), set()).add(p - o - int(start[d]))
        for (d, n), places in sorted(aligned.items()):
            item_id, item = self.items[n]
            m, e = len(item), max_edits(len(item))
            best = None
            for lo, hi in self._regions(sorted(places), m, e):
                hit = nearest(item.tolist(), docs[d][lo:hi].tolist(), e)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1], lo + hit[2])
            if best:
                out[d].append((item_id, best[1], best[2], best[0], m))
        return out

    @staticmethod
    def _regions(places: list[int], m: int, e: int) -> list[tuple[int, int]]:
        """Windows of the item's size and slack, overlapping ones merged."""
        regions: list[list[int]] = []
        for a in places:
            if regions and a - e <= regions[-1][1]:
                regions[-1][1] = a + m + e
            else:
                regions.append([max(0, a - e), a + m + e])
        return [(lo, hi) for lo, hi in regions]


def _blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Broadcast indexes of the benchmark, a bounded number of words at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        index = Index([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))])
        if index.items:
            yield spark.sparkContext.broadcast(index)


def _spans(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of normalised words as code-point ranges of the text."""
    own = text.encode()
    raw = own.lower().translate(_TABLE)
    place, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        place.append((at, at + len(w)))
        at += len(w)
    return [(len(own[:place[a][0]].decode()), len(own[:place[b - 1][1]].decode())) for a, b in words]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and matched item: doc_id, item_id, start, end
    (code points of the best window), edits, item_words."""
    schema = "doc_id long, item_id long, start long, end long, edits int, item_words int"
    own = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in _blocks(benchmark):
        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [x or "" for x in b.column(1).to_pylist()]
                rows = []
                for doc_id, text, hits in zip(b.column(0).to_pylist(), texts,
                                              index.value.search([hashed(words_of(t)) for t in texts])):
                    if hits:
                        spans = _spans(text, [(h[1], h[2]) for h in hits])
                        rows += [(doc_id, h[0], s, e, h[3], h[4]) for h, (s, e) in zip(hits, spans)]
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 ["doc_id", "item_id", "start", "end", "edits", "item_words"])
        part = own.mapInArrow(scan, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no benchmark item, with their own columns."""
    for index in _blocks(benchmark):
        schema = T.StructType([*docs.schema.fields, T.StructField("__leaks", T.BooleanType())])
        at = docs.columns.index("text")

        def scan(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = index.value.search([hashed(words_of(x)) for x in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bool(h) for h in hits], pa.bool_())],
                                                 [*b.schema.names, "__leaks"])
        docs = docs.mapInArrow(scan, schema).where(~F.col("__leaks")).drop("__leaks")
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
