"""LM scoring with a hierarchical Pitman-Yor model (operator 10).

The model is a two-level hierarchy of Chinese restaurants.  A token's context
is the word before it; every previous word is a restaurant of its own, keyed by
its 64-bit hash, so the restaurants grow with the input.  All share one parent,
the unigram restaurant, whose base is uniform over the V known tokens and one
unknown.  Customers are the training tokens.  A prediction needs only the
number of tables of each dish, so a sweep draws that number anew for every dish
from its conditional distribution (generalised Stirling numbers, beyond SMALL
customers by a corrected saddle point, whose weights are within 4 %): all
customers of a dish are seated again at once, however many there are.  The
averages over the samples kept give the predictive probabilities.

How it is spread:

* Documents are read once, into *blocks* of about ``BLOCK_TOKENS`` tokens, which
  are landed as numbers of their words, about a byte and a half a token.
* Every block sends its distinct (word, context) pairs and their counts, once, to
  *pair buckets* by the hash of both words, so neither a hot word nor a hot
  context meets in one bucket, and a dish is whole in one.  A bucket keeps the
  places of each block's pairs among its own, which ascend: under a byte a pair.
* A dish of one customer has one table in every draw.  Its share of the sums
  goes once to the *key bucket* of its word and of its context; only dishes of
  two customers or more, and their words, take part in the rounds.
* A sweep is a round: pair buckets draw the tables of their dishes and send
  partial sums per word and per context to the key bucket of that hash; key
  buckets add them up, draw the parent's tables and answer each pair bucket
  with the corpus sums of its words and contexts.  Every round is a landed
  table.  All dishes of a round are drawn given the sums of the round before.
* A draw's random number comes from the hashes and the round, so results do
  not depend on the number of buckets or partitions.
* At the end pair buckets answer each block's pairs with counts and sampled
  tables, key buckets its words with their averages; blocks turn them into
  scores per document.
* Shuffle files of a landed table are deleted with its query, and a landed table
  as soon as nothing reads it, so the disk holds one shuffle at a time.

The number of buckets follows the tokens.  Six sums reach the driver.  Words are compared by 64-bit hashes.

Defined cases: null and empty texts are the end token alone; a null doc_id
counts as held out; repeated rows are scored each; without training documents
N and V are 0 and every token is the unknown one; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import doc_fold, drop_landed, hash_words, land, mix64, read_table

FOLDS = 10
BLOCK_TOKENS = 800_000
#: discount and strength of the context restaurants and of their parent
DISCOUNT, STRENGTH = 0.8, 2.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
#: rounds before the first sample, and samples kept; a round draws every dish
BURN_IN, SAMPLES = 3, 3
#: up to so many customers a dish's distribution is computed in full
SMALL = 128
#: customers at which the saddle point's error is read off the exact numbers
FULL = 2048
#: tokens of the blocks to a bucket; a task holds one bucket at a time, and fewer buckets name a block's words less often
BUCKET_TOKENS = 1_350_000
#: parts of the pair buckets that get the blocks' pairs one after the other, so that a part of them is in shuffle files at a time
PARTS = 2
#: bytes that a task passes to Python at once
BATCH_BYTES = 4 << 20
SEED = 10
#: documents taken from a batch at once
SLICE = 256
#: white space cannot be part of a word, so this is no word's hash but by collision
END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte by byte: the high bytes of numbers
    are mostly zero and compress."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    buf, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(buf):
        kind, size = struct.unpack_from("<2sQ", buf, at)
        at, width = at + 10, int(kind[1:2])
        rows = np.frombuffer(buf, np.uint8, size, at).reshape(width, -1)
        out.append(np.ascontiguousarray(rows.T).view("<" + kind.decode()).ravel())
        at += size
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return small(np.diff(x, prepend=x.dtype.type(0)))


def steps_back(x: np.ndarray, kind: type = np.int64) -> np.ndarray:
    return np.cumsum(x, dtype=kind)


# ------------------------------------------------------------------- blocks
_K = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix64(mix64(word) * _K ^ context)


def _block(doc_ids: list, train: list, hashes: list[np.ndarray]) -> tuple[int, bytes, int]:
    """(block, payload, -tokens): the documents, the words and every token's word,
    words numbered by falling count."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    words, seq = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(seq)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
    null = np.array([x is None for x in doc_ids], np.uint8)
    ids = np.array([0 if x is None else x for x in doc_ids], np.int64)
    return (int.from_bytes(os.urandom(8), "little") >> 1,
            pack(ids, null, np.array(train, np.uint8), small(sizes), steps(words), small(count), small(rank)[seq]), -len(seq))


def _open(payload: bytes, buckets: int) -> tuple:
    """(ids, null, train, sizes, words, word and context of each distinct pair, its
    place in the order of the pair buckets, where each bucket's pairs begin, the
    place of each token's pair): pairs ascend within their bucket."""
    ids, null, train, sizes, words, count, seq = unpack(payload)
    sizes, words = sizes.astype(np.int64), steps_back(words, np.uint64)
    seq = np.argsort(-count.astype(np.int64), kind="stable").astype(np.int32)[seq]
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[np.cumsum(sizes) - sizes] = np.searchsorted(words, END)      # a text begins after the end of another
    pairs, place = np.unique(seq * np.int64(len(words)) + before, return_inverse=True)
    del seq, before
    word, context = (x.astype(np.int32) for x in np.divmod(pairs, len(words)))
    bucket = (pair_hash(words[word], words[context]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return (ids, null, train, sizes, words, word[order], context[order],
            np.searchsorted(bucket[order], np.arange(buckets + 1)), rank[place])


def document_blocks(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, hashes, n = [], [], [], 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            for doc_id, learn, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.lower().split()
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = hash_words(words)
                h[-1] = END
                ids.append(doc_id)
                train.append(learn)
                hashes.append(h)
                n += len(h)
                if n >= BLOCK_TOKENS:
                    yield _batch([_block(ids, train, hashes)])
                    ids, train, hashes, n = [], [], [], 0
        if ids:
            yield _batch([_block(ids, train, hashes)])
    own = docs.select(F.col("doc_id").cast("long"), (doc_fold(F.col("doc_id"), folds) != 0).alias("train"),
                      F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(read, ROW)


def _batch(rows: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
    """Rows (block, payload, bucket) as Arrow."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                       enumerate((pa.int64(), pa.binary(), pa.int32()))], ["block", "payload", "bucket"])


def _of_blocks(blocks: DataFrame, asks) -> DataFrame:
    """Rows (block, payload, bucket) that ``asks`` makes of each block's payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _batch([(block, x, b) for b, x in asks(payload.as_py())])
    return blocks.select("block", "payload").mapInArrow(run, ROW)


def _ask_pairs(payload: bytes, buckets: int, part: int, parts: int = PARTS) -> Iterator[tuple[int, bytes]]:
    """A block's distinct pairs and their training counts, for each pair bucket of a part."""
    _, _, train, sizes, words, word, context, cut, place = _open(payload, buckets)
    count = np.bincount(place[np.repeat(train.astype(bool), sizes)], minlength=len(word))
    for b in np.flatnonzero(np.diff(cut)):
        if b % parts != part:
            continue
        own = slice(cut[b], cut[b + 1])
        used, at = np.unique(np.concatenate([word[own], context[own]]), return_inverse=True)
        n = cut[b + 1] - cut[b]
        yield int(b), pack(steps(words[used]), steps(at[:n]), small(at[n:]), small(count[own]))


def _ask_words(payload: bytes, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A block's words for each key bucket."""
    words = steps_back(unpack(payload)[4], np.uint64)
    order, cut = _by_key(words, buckets)
    for v in np.flatnonzero(np.diff(cut)):
        yield int(v), pack(steps(words[order[cut[v]:cut[v + 1]]]))


# ------------------------------------------------------------------ seating
class Seating:
    """Tables of many dishes, each with its own customers, moved by Gibbs: a
    random customer of every dish leaves and is seated anew.  The plain sampler
    that :func:`draw_tables` is compared with."""

    def __init__(self, customers: np.ndarray, discount: float, new: np.ndarray, rng: np.random.Generator):
        self.c, self.d, self.rng = customers.astype(np.int64), discount, rng
        self.start = np.cumsum(self.c) - self.c
        n = int(self.c.sum())
        # begin with about the expected number of tables, equally filled
        first = np.clip(np.rint(1 + new * np.log1p((self.c - 1) / (new + 1))), 1, self.c).astype(np.int64)
        self.tables = first
        kind = np.int32 if n < 1 << 31 else np.int64
        begin = np.repeat(self.start.astype(kind), self.c)
        self.table = begin + (np.arange(n, dtype=kind) - begin) % np.repeat(first.astype(kind), self.c)
        self.size = np.bincount(self.table, minlength=n).astype(np.int32)

    def move(self, new: np.ndarray, at: np.ndarray) -> None:
        """Reseat one customer of each dish in ``at``; ``new[i]`` is the weight
        of a new table for dish at[i]."""
        rng, c, start = self.rng, self.c[at], self.start[at]
        who = start + (rng.random(len(at)) * c).astype(np.int64)
        self.size[self.table[who]] -= 1
        self.tables[at] -= self.size[self.table[who]] == 0
        rest = (c - 1) - self.d * self.tables[at]
        opens = rng.random(len(at)) * (new + rest) < new
        # an existing table: that of another customer (proportional to size), accepted with (size - d) / size
        todo = np.flatnonzero(~opens)
        while len(todo):
            k = (rng.random(len(todo)) * (c[todo] - 1)).astype(np.int64)
            other = start[todo] + k + (start[todo] + k >= who[todo])
            t = self.table[other]
            ok = rng.random(len(todo)) * self.size[t] < self.size[t] - self.d
            self.table[who[todo[ok]]] = t[ok]
            self.size[t[ok]] += 1
            todo = todo[~ok]
        # a new table: any empty slot of the dish (there are as many slots as customers)
        todo = np.flatnonzero(opens)
        self.tables[at[todo]] += 1
        slot = who.copy()
        while len(todo):
            free = self.size[slot[todo]] == 0
            done = todo[free]
            self.table[who[done]] = slot[done]
            self.size[slot[done]] = 1
            todo = todo[~free]
            slot[todo] = start[todo] + (rng.random(len(todo)) * c[todo]).astype(np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: eight steps up, then Stirling's series."""
    x, shift = np.asarray(x, float), 0.0
    for i in range(8):
        shift = shift + np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / 1260 / y**2) / y**2) / y - shift


@cache
def _log_stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to SMALL: the weight of all seatings of c
    customers at t tables."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, SMALL):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - d * t, 1e-300)) + out[c, 1:c + 2]
        out[c + 1, 1:c + 2] = np.logaddexp(out[c, :c + 1], stay)
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) / c! for t < c by saddle point: the coefficient of x^c in
    ((1 - (1 - x)^d) / d)^t / t!."""
    # the mean c / t fixes v; log log of it is nearly straight in log v, so Newton's steps settle at once
    goal = np.log(c / t)
    v = np.maximum(2 * goal / (1 - d), 1e-9)
    for _ in range(7):
        mean = np.maximum(np.log(np.expm1(-v) / np.expm1(-d * v) * d) + v * (1 - d), 1e-300)
        slope = np.where(v < 1e-3, (1 - d) / 2, (1 - d) + 1 / np.expm1(v) - d / np.expm1(d * v))
        v = v * np.exp(np.clip(np.log(goal / mean) * mean / (v * slope), -3, 3))
    x, f = -np.expm1(-v), -np.expm1(-d * v)
    spread = c * x * np.exp(v) * ((1 - d) + np.exp(-v) / x - d * np.exp(-d * v) / f)
    return t * np.log(f / d) - c * np.log(x) - 0.5 * np.log(2 * np.pi * spread) - _lgamma(t + 1)


@cache
def _saddle_error(d: float) -> tuple[np.ndarray, np.ndarray]:
    """What the saddle point misses at FULL customers, by number of tables;
    first the part up to half the customers, by log t, then by c - t."""
    row = np.full(FULL + 1, -np.inf)
    row[1] = 0.0
    for c in range(1, FULL):
        t = np.arange(1, c + 2)
        row[1:c + 2] = np.logaddexp(row[:c + 1], np.log(np.maximum(c - d * t, 1e-300)) + row[1:c + 2])
    t = np.arange(1.0, FULL)
    c = np.full(len(t), float(FULL))
    error = row[1:FULL] - _lgamma(c + 1) - _saddle(c, t, d)
    return error[:FULL // 2], error[::-1][:FULL // 2]


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) / c! for c > SMALL.  The saddle point's error depends on
    t / c^d where t is small (one table holds most customers) and on c - t where
    that is small."""
    few, full = _saddle_error(d)
    at = np.log(np.maximum(t, 1) * (FULL / c) ** d)
    grid = np.log(np.arange(1.0, len(few) + 1))
    low = np.interp(at, grid, few) + np.minimum(at, 0) * (few[1] - few[0]) / grid[1]
    high = np.interp(c - t, np.arange(1.0, len(full) + 1), full)
    some = _saddle(c, np.minimum(t, c - 1), d) + np.where(t <= c / 2, low, high)
    return np.where(t < c, some, -_lgamma(c + 1))


def draw_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, strength: float, u: np.ndarray) -> np.ndarray:
    """The number of tables of each dish, drawn from its distribution given
    the dish's base probability ``p`` and the ``others`` tables of its
    restaurant; ``u`` are uniform numbers."""
    out = np.minimum(c, 1).astype(np.int64)
    low = 1
    while low < SMALL:
        high = 2 * low
        for at in _chunks(np.flatnonzero((c > low) & (c <= high)), 1 << 20, high):
            seats = np.cumsum(np.log((strength + d * (others[at, None] + np.arange(high))) * p[at, None]), axis=1)
            weight = _log_stirling(d)[c[at], 1:high + 1] + seats
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = np.minimum(1 + (weight < (u[at] * weight[:, -1])[:, None]).sum(axis=1), c[at])
        low = high
    for at in _chunks(np.flatnonzero(c > SMALL), 1 << 18, 129):
        out[at] = _draw_many(c[at].astype(float), p[at], others[at], d, strength, u[at])
    return out


def _chunks(at: np.ndarray, cells: int, width: int) -> list[np.ndarray]:
    step = max(1, cells // width)
    return [at[i:i + step] for i in range(0, len(at), step)]


def _draw_many(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, strength: float, u: np.ndarray) -> np.ndarray:
    """Dishes of more than SMALL customers: the log weight is concave in the
    number of tables; its top is found by halving, the part around it that
    holds all mass but e^-30 is laid out on at most 129 points."""
    start = strength / d + others

    def weight(t):
        k, s, q = (x[:, None] if t.ndim == 2 else x for x in (c, start, p))
        k = np.broadcast_to(k, t.shape)
        return log_seatings(k, t, d) + t * np.log(d * q) + _lgamma(s + t)
    lo, hi = np.ones(len(c)), c.copy()
    while (lo < hi).any():
        mid = np.floor((lo + hi) / 2)
        up = (weight(np.minimum(mid + 1, c)) > weight(mid)) & (mid < c)
        lo, hi = np.where(up & (lo < hi), mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
    top, best = lo, weight(lo)
    ends = []
    for side, limit in ((-1, np.ones(len(c))), (1, c)):
        near, far = top.copy(), limit.copy()              # the last point within reach lies between
        while (np.abs(far - near) > 1).any():
            mid = np.floor((near + far) / 2)
            inside = best - weight(mid) < 30
            near, far = np.where(inside, mid, near), np.where(inside, far, mid)
        ends.append(far)
    step = np.maximum(1.0, (ends[1] - ends[0]) / 128)
    t = ends[0][:, None] + np.arange(129) * step[:, None]
    ok = t <= ends[1][:, None] + 0.5
    w = np.where(ok, np.exp(weight(np.minimum(t, c[:, None])) - best[:, None]), 0.0)
    total = np.cumsum(w, axis=1)
    goal = u * total[:, -1]
    cell = np.minimum((total < goal[:, None]).sum(axis=1), 128)
    row = np.arange(len(c))
    inside = (goal - total[row, cell] + w[row, cell]) / np.maximum(w[row, cell], 1e-300)
    return np.clip(np.rint(t[row, cell] + (inside - 0.5) * (step - 1)), 1, c).astype(np.int64)


def _uniform(h: np.ndarray, turn: int) -> np.ndarray:
    """One number in (0, 1) for each hash and round."""
    key = int(mix64(np.array([SEED * 1000 + turn], np.uint64))[0])
    return ((mix64(mix64(h ^ np.uint64(key)) * _K) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _draw_root(c0: np.ndarray, t0: np.ndarray, root: tuple, h: np.ndarray, turn: int) -> np.ndarray:
    """The parent's tables for the tables its children have now."""
    _, tables, v = root
    return draw_tables(c0, np.full(len(c0), 1 / (v + 1)), np.maximum(tables - t0, 0), ROOT_DISCOUNT, ROOT_STRENGTH,
                       _uniform(h ^ END, turn))


def _draw_pairs(count: np.ndarray, tables: np.ndarray, left: np.ndarray, of_context: np.ndarray, root: tuple,
                h: np.ndarray, turn: int) -> np.ndarray:
    """Tables of pairs: ``left`` is c0 - d0 t0 of the pair's word, ``of_context``
    the tables of its context, ``root`` (customers, tables, V) of the parent."""
    c0, t0, v = root
    p0 = (left + (ROOT_STRENGTH + ROOT_DISCOUNT * t0) / (v + 1)) / (ROOT_STRENGTH + c0)
    return draw_tables(count, p0, np.maximum(of_context - tables, 0), DISCOUNT, STRENGTH, _uniform(h, turn))


def sample_bucket(word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int, buckets: int = 1,
                  seed: int = SEED, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The whole model in one process, as the rounds compute it in any number
    of ``buckets``: averaged (c - d t) per pair, averaged (c0 - d0 t0) per word,
    and sums per context and of the root.  ``names`` are the hashes of the
    numbers that stand for words and contexts."""
    if names is None:
        names = mix64(np.arange(max(n_words, int(context.max(initial=0)) + 1), dtype=np.uint64) + np.uint64(seed))
    h, c = pair_hash(names[word], names[context]), count.astype(np.int64)
    tables, t0, n = np.minimum(c, 1), np.zeros(n_words, np.int64), len(names)
    known = np.bincount(word, weights=c, minlength=n_words)
    v = float((known > 0).sum())
    root, kept = (0.0, v, v), [np.zeros(len(c)), np.zeros(n_words), np.zeros(n), np.zeros(2)]
    for turn in range(BURN_IN + SAMPLES):
        c0 = np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
        t_k = np.bincount(context, weights=tables, minlength=n)
        t0 = _draw_root(c0, t0, root, names[:n_words], turn)
        root = (float(c0.sum()), float(t0.sum()), v)
        tables = _draw_pairs(c, tables, (c0 - ROOT_DISCOUNT * t0)[word], t_k[context], root, h, turn)
        if turn >= BURN_IN:
            c0 = np.bincount(word, weights=tables, minlength=n_words).astype(np.int64)
            drawn = _draw_root(c0, t0, root, names[:n_words], turn + 1)
            for x, y in zip(kept, (c - DISCOUNT * tables, c0 - ROOT_DISCOUNT * drawn,
                                   np.bincount(context, weights=tables, minlength=n), np.array([c0.sum(), drawn.sum()]))):
                x += y / SAMPLES
    return kept[0], kept[1], {"c_k": np.bincount(context, weights=c, minlength=n), "t_k": kept[2],
                              "rest": np.array([known.sum(), v, *kept[3]])}


# ------------------------------------------------------------------- rounds
ROW = "block long, payload binary, bucket int"
#: kinds of rows.  Pair bucket to key bucket: tables of the dishes that are drawn, each round, and once the sums that stay;
#: key bucket to pair bucket; states of a pair bucket: the dishes that are drawn, their tables, all counts, the places of a
#: block's pairs (sender: the block); states of a key bucket: what stays, and what moves
SENT, STAYS, TOLD, PAIRS, TABLES, COUNTS, PLACES, WORDS, MOVES = range(9)
STEP = "step int, sender long, bucket int, payload binary, c0 double, t0 double, n double, v double"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary()) + (pa.float64(),) * 4
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(STEP.split(", "), kinds))})


def _merged(asked: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(hashes, word, context, count, place of every asked pair) of a bucket."""
    cut = np.cumsum([0, *(len(x[0]) for x in asked)])
    hashes, of = np.unique(np.concatenate([steps_back(x[0], np.uint64) for x in asked]), return_inverse=True)
    of = of.astype(np.int32)
    pairs, at = np.unique(np.concatenate([of[i:][steps_back(word, np.int32)] * np.int64(len(hashes)) + of[i:][context]
                                          for i, (_, word, context, _) in zip(cut, asked)]), return_inverse=True)
    at = at.astype(np.int32)
    count = np.bincount(at, weights=np.concatenate([x[3] for x in asked]), minlength=len(pairs)).astype(np.int64)
    return hashes, *np.divmod(pairs, len(hashes)), count, at


def _by_key(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the hashes by key bucket, and where each bucket's begin."""
    key = (mix64(hashes ^ END) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key[order], np.arange(buckets + 1))


def _send(kind: int, b: int, hashes: np.ndarray, word: np.ndarray, context: np.ndarray, buckets: int, values: list) -> list[tuple]:
    """Partial sums of ``values`` per word and per context for the key buckets."""
    sums = [np.bincount(of, weights=x, minlength=len(hashes)).astype(np.uint64) for x in values for of in (word, context)]
    order, cut = _by_key(hashes, buckets)
    return [(kind, b, int(v), pack(steps(hashes[o]), *(small(x[o]) for x in sums)))
            for v in np.flatnonzero(np.diff(cut)) for o in (order[cut[v]:cut[v + 1]],)]


def _payloads(table: pa.Table) -> list[tuple[int, int, list[np.ndarray]]]:
    return [(s, k, unpack(x.as_py())) for s, k, x in
            zip(table.column("step").to_pylist(), table.column("sender").to_pylist(), table.column("payload"))]


def _begin(table: pa.Table, buckets: int) -> pa.Table:
    """One pair bucket: merge the blocks' requests.  A dish of one customer has
    one table for good; the others take part in the rounds and begin with one."""
    b = table.column("bucket")[0].as_py()
    asked = [unpack(x.as_py()) for x in table.column("payload")]
    hashes, word, context, count, at = _merged(asked)
    out, base = [(COUNTS, b, b, pack(small(count)))], 0
    for block, x in zip(table.column("block").to_pylist(), asked):
        out.append((PLACES, block, b, pack(steps(at[base:base + len(x[1])]))))
        base += len(x[1])
    out += _send(STAYS, b, hashes, word, context, buckets, [count == 1, count])
    drawn = np.flatnonzero(count > 1)
    if len(drawn):
        used, at = np.unique(np.concatenate([word[drawn], context[drawn]]), return_inverse=True)
        hashes, word, context, tables = hashes[used], at[:len(drawn)], at[len(drawn):], np.ones(len(drawn), np.uint8)
        out += [(PAIRS, b, b, pack(steps(hashes), steps(word), small(context), small(count[drawn]))),
                (TABLES, b, b, pack(tables, np.zeros(0, np.uint8))), *_send(SENT, b, hashes, word, context, buckets, [tables])]
    return _rows(out)


def _gather(table: pa.Table) -> pa.Table:
    """One key bucket: what its words and contexts have for good."""
    v, rows = table.column("bucket")[0].as_py(), [x for _, _, x in _payloads(table)]
    hashes, of = np.unique(np.concatenate([steps_back(x[0], np.uint64) for x in rows]), return_inverse=True)
    sums = [np.bincount(of, weights=np.concatenate([x[i] for x in rows]), minlength=len(hashes)).astype(np.int64) for i in range(1, 5)]
    return _rows([(WORDS, v, v, pack(steps(hashes), *map(small, sums)), None, None, float(sums[2].sum()), float((sums[2] > 0).sum()))])


def _sweep(table: pa.Table, buckets: int, turn: int, root: tuple) -> pa.Table:
    """One pair bucket: draw its dishes of several customers given the corpus sums."""
    b, rows = table.column("bucket")[0].as_py(), _payloads(table)
    by = {s: x for s, _, x in rows if s != TOLD}
    hashes, word, context, count = by[PAIRS]
    hashes, word, count = steps_back(hashes, np.uint64), steps_back(word), count.astype(np.int64)
    order, cut = _by_key(hashes, buckets)
    left, t_k = np.empty(len(hashes)), np.empty(len(hashes))
    for v, x in ((k, x) for s, k, x in rows if s == TOLD):
        own = order[cut[v]:cut[v + 1]]
        left[own], t_k[own] = x
    tables, kept = (x.astype(np.int64) for x in by[TABLES])
    tables = _draw_pairs(count, tables, left[word], t_k[context], root, pair_hash(hashes[word], hashes[context]), turn)
    if turn >= BURN_IN:
        kept = tables + (kept if len(kept) else 0)
    return _rows([(TABLES, b, b, pack(small(tables), small(kept))), *_send(SENT, b, hashes, word, context, buckets, [tables])])


def _add_up(table: pa.Table, turn: int, root: tuple) -> pa.Table:
    """One key bucket: corpus sums of its words and contexts, the parent's
    tables, and an answer to each pair bucket."""
    v, rows = table.column("bucket")[0].as_py(), _payloads(table)
    hashes, c0, t_k, _, _ = next(x for s, _, x in rows if s == WORDS)
    hashes, c0, t_k = steps_back(hashes, np.uint64), c0.astype(np.int64), t_k.astype(float)
    asked = [(k, np.searchsorted(hashes, steps_back(x[0], np.uint64)), x[1:]) for s, k, x in rows if s == SENT]
    for _, of, (by_word, by_context) in asked:
        c0[of] += by_word.astype(np.int64)
        t_k[of] += by_context
    t0, kept_left, kept_t = next((x for s, _, x in rows if s == MOVES), (np.zeros(len(hashes)),) * 3)
    t0 = _draw_root(c0, t0, root, hashes, turn)
    left = c0 - ROOT_DISCOUNT * t0
    if turn > BURN_IN:
        kept_left, kept_t = kept_left + left / SAMPLES, kept_t + t_k / SAMPLES
    told = [left.astype(np.float32), t_k.astype(np.float32)]
    return _rows([(MOVES, v, v, pack(small(t0), kept_left, kept_t), float(c0.sum()), float(t0.sum())),
                  *((TOLD, v, b, pack(*(x[of] for x in told))) for b, of, _ in asked if turn < BURN_IN + SAMPLES)])


def _answer_pairs(table: pa.Table) -> pa.Table:
    """One pair bucket: counts and sampled tables of each block's pairs."""
    b, rows = table.column("bucket")[0].as_py(), _payloads(table)
    by = {s: x for s, _, x in rows if s != PLACES}
    count = by[COUNTS][0].astype(np.int64)
    kept = count * SAMPLES
    if TABLES in by:
        kept[count > 1] = by[TABLES][1]
    return pa.Table.from_batches([_batch([(k, pack(small(count[at]), small(kept[at])), b)
                                          for s, k, x in rows if s == PLACES for at in (steps_back(x[0]),)])])


def _answer_words(asked: pa.Table, state: pa.Table) -> pa.Table:
    """One key bucket: averages over the samples and counts of each block's words,
    sent as bucket -2 - v."""
    v, by = asked.column("bucket")[0].as_py(), {s: x for s, _, x in _payloads(state)}
    hashes, values = steps_back(by[WORDS][0], np.uint64), (*by[MOVES][1:], *by[WORDS][3:])
    return pa.Table.from_batches([_batch([(k, pack(*(x[of] for x in values)), -2 - v)
                                          for k, x in zip(asked.column("block").to_pylist(), asked.column("payload"))
                                          for of in (np.searchsorted(hashes, steps_back(unpack(x.as_py())[0], np.uint64)),)])])


def _score_block(table: pa.Table, buckets: int, root: tuple, n: float) -> pa.Table:
    """Scores of a block's documents from the answers to its pairs and words."""
    rows = dict(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()))
    ids, null, train, sizes, words, word, context, _, place = _open(rows[-1], buckets)
    parts = [unpack(rows[b]) for b in sorted(rows) if b >= 0]
    count, kept = (np.concatenate([x[i] for x in parts]).astype(float) for i in range(2))
    left, t_k, c_w, c_k = values = [np.empty(len(words)) for _ in range(4)]
    order, cut = _by_key(words, buckets)
    for b in (b for b in rows if b < -1):
        for x, own in zip(values, unpack(rows[b])):
            x[order[cut[-2 - b]:cut[-1 - b]]] = own
    c0, t0, v = root
    p0 = (left + (ROOT_STRENGTH + ROOT_DISCOUNT * t0) / (v + 1)) / (ROOT_STRENGTH + c0)
    p = (count - DISCOUNT * kept / SAMPLES + (STRENGTH + DISCOUNT * t_k[context]) * p0[word]) / (STRENGTH + c_k[context])
    base = np.log10((c_w + 0.1) / (n + 0.1 * (v + 1)))
    ends = np.cumsum(sizes)
    total = lambda x: np.add.reduceat(x[place], ends - sizes)  # noqa: E731  every document has its end token
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(train == 0),
        "n_tokens": pa.array(sizes), "n_known": pa.array(total((c_w > 0).astype(np.int64)[word])),
        "train_tokens": pa.array(np.full(len(ids), int(n))), "base_score": pa.array(total(base[word])),
        "score": pa.array(total(np.log10(p.astype(np.float32).astype(float))))})


def _land(df: DataFrame, name: str) -> DataFrame:
    """:func:`land` with small batches; the shuffle files of a landed table go once
    it is written, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: conf.get(k, None) for k in own}
    for k, x in own.items():
        conf.set(k, x)
    try:
        return land(df, name)
    finally:
        for k, x in before.items():
            conf.unset(k) if x is None else conf.set(k, x)


def score(docs: DataFrame, folds: int = FOLDS, buckets: int | None = None) -> DataFrame:
    """Model and baseline log10 probabilities of every document of ``docs``,
    learned from those outside fold 0."""
    blocks = _land(document_blocks(docs, folds), "py-blocks")
    buckets = buckets or -(-(blocks.agg(-F.sum("bucket").cast("long")).first()[0] or 1) // BUCKET_TOKENS)
    parts = [_land(_of_blocks(blocks, _bound(_ask_pairs, buckets, k)).groupBy("bucket")
                   .applyInArrow(_bound(_begin, buckets), STEP), "py-begin") for k in range(min(PARTS, buckets))]
    sent = begun = reduce(DataFrame.union, parts)
    words = _land(begun.where(f"step = {STAYS}").groupBy("bucket").applyInArrow(_gather, STEP), "py-words")
    n, v = (x or 0.0 for x in words.agg(F.sum("n"), F.sum("v")).first())
    root, kept, told = (0.0, v, v), [], None
    for turn in range(BURN_IN + SAMPLES + 1):
        heard = sent.where(f"step = {SENT}").union(words)
        heard = heard if told is None else heard.union(told.where(f"step = {MOVES}"))
        before, told = told, _land(heard.groupBy("bucket").applyInArrow(_bound(_add_up, turn, root), STEP), "py-keys")
        if before is not None:
            drop_landed(before)
        got = told.where(f"step = {MOVES}").agg(F.sum("c0"), F.sum("t0")).first()
        root = (got[0] or 0.0, got[1] or 0.0, v)
        if turn > BURN_IN:
            kept.append(root)
        if turn < BURN_IN + SAMPLES:
            state = (begun.where(f"step = {PAIRS}").union(sent.where(f"step = {TABLES}"))
                     .union(told.where(f"step = {TOLD}")))
            before, sent = sent, _land(state.groupBy("bucket").applyInArrow(_bound(_sweep, buckets, turn, root), STEP), "py-tables")
            if before is not begun:
                drop_landed(before)
    root = (*(sum(x[i] for x in kept) / SAMPLES for i in range(2)), v)
    places = begun.where(f"step in ({COUNTS}, {PLACES})").union(sent.where(f"step = {TABLES}"))
    of_pairs = _land(places.groupBy("bucket").applyInArrow(_answer_pairs, ROW), "py-of-pairs")
    for x in (*parts, sent):
        drop_landed(x)
    asked = _of_blocks(blocks, lambda x: _ask_words(x, buckets))
    state = words.union(told.where(f"step = {MOVES}"))
    of_words = _land(asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(_answer_words, ROW), "py-of-words")
    drop_landed(words)
    drop_landed(told)
    own = blocks.select("block", "payload", F.lit(-1).alias("bucket"))
    scores = _land(own.union(of_pairs).union(of_words).groupBy("block")
                   .applyInArrow(lambda t: _score_block(t, buckets, root, n),
                                 "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double"), "py-scores")
    for x in (blocks, of_pairs, of_words):
        drop_landed(x)
    return scores


def _bound(step, *values):
    """``step`` of a table or payload, with the ``values`` of now."""
    return lambda t: step(t, *values)


def query(spark, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
