"""Substring dedup with a count-min prefilter (operator 11).

A *window* is ``WINDOW`` consecutive words of one document.  A word goes when a
window over it also starts in a document with a smaller ``doc_id``.

1. ``pack``: documents become blocks of about ``BLOCK_BYTES`` of words, one row
   each, landed once; every later pass reads blocks.
2. Each block sketches its windows: a count-min row has ``CELLS`` cells per
   window of the whole corpus (so a row is as sparse at every size), and a block
   sends the cells it touches, cut into ranges of cells, as packed differences
   with a bit for "two or more documents here".  A cell counts documents.
3. ``merge_sketches``: the sketches of all blocks meet range by range.  A block
   gets one bit back for each cell it sent: whether the merged count is two or
   more.  No block, executor or driver ever holds the merged sketch.
4. Second pass: windows whose cells reach two in every row are *estimated
   repeated*.  Counts are never too low, so no repeated window is lost; only
   these windows, about a twentieth more than there are repeats, are grouped
   exactly, by 128-bit hash with the least doc_id of their block, and the
   block gets back whether a smaller doc_id holds the window elsewhere.
5. Third pass: words of such windows are cut from the texts of the block.

A window costs about a byte per sketch row in the first shuffle; a window that a
third of all documents share is one entry per block.  A block's bits are joined
back by block number.  Windows are compared by a 64-bit hash inside a block and
by 128 bits between blocks, both over 64-bit hashes of words.

Defined cases: null, empty and blank texts have no words and keep an empty text;
texts under ``WINDOW`` words lose nothing; of rows that share a doc_id neither
takes words from the other, and each gives a row; a row with a null doc_id
takes no part (it loses nothing and takes nothing from others); repeats inside
one document stay; an empty table gives an empty one; extra columns are ignored.
Texts of any length are read whole; a text larger than a block is a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import land, mix64, read_table

WINDOW = 13
#: bytes of words in a block
BLOCK_BYTES = 8 << 20
#: rows of the sketch, and its cells per window of the corpus
ROWS, CELLS = 2, 4
#: log2 of the cells in one range of a sketch row
RANGE_BITS = 21
#: log2 of the windows whose hashes meet in one exact group, were all repeated
PART_BITS = 20
_M = mix64(np.arange(1, 2 * WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALT, _ALL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFFFFFFFFFF)
#: bytes of a word that is hashed by itself
LONG_WORD = 256
BLOCK = "block long, ids array<long>, windows long, words binary"


# ------------------------------------------------------------------ blocks
def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as blocks: their ids in ascending order (nulls first), the
    number of windows of documents that have an id, and the words: a line per
    document, words parted by one space, compressed."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            n = sum(max(0, k - WINDOW + 1) for i, k, _ in held if i is not None)
            words = zstandard.compress(b"\n".join(x[2] for x in held), 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), pa.array([[x[0] for x in held]], pa.list_(pa.int64())),
                 pa.array([n], pa.int64()), pa.array([words], pa.binary())], ["block", "ids", "windows", "words"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                line = b" ".join(words)
                if held and size + len(line) > block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
                held.append((doc_id, len(words), line))
                size += len(line) + 1
        if held:
            yield block()
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
            .mapInArrow(blocks, BLOCK))


def hash_lanes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``start`` of ``size`` bytes, eight bytes
    of all words at a time."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(text), "<u8", padded, strides=(1,))
    h = mix64(size.astype(np.uint64) * _M[0])
    live = np.flatnonzero(size <= LONG_WORD)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[start[k]:start[k] + size[k]].tobytes())
    at, left = start[live], size[live]
    while len(live):
        lane = lanes[at] & (_ALL >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64))
        h[live] = mix64((h[live] ^ lane) * _M[1])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


class Windows:
    """The windows of a block, sorted by hash.

    ``hashes``: distinct 64-bit hashes, ascending; ``least``: the least doc_id of
    each; ``several``: whether two doc_ids hold it; ``at``: first word of every
    window, ``entry`` its place in ``hashes``, ``id`` its doc_id; ``doc``: document of every word.
    """

    def __init__(self, ids: list, payload: bytes):
        self.text = zstandard.decompress(payload)
        raw = np.frombuffer(self.text, np.uint8)
        gaps = np.flatnonzero((raw == ord(" ")) | (raw == ord("\n")))
        start, end = np.append(0, gaps + 1), np.append(gaps, len(raw))
        full = end > start                       # an empty document is an empty line
        start, end = start[full], end[full]
        self.doc = np.searchsorted(np.flatnonzero(raw == ord("\n")), start)
        self.words = hash_lanes(raw, start, end - start)
        known = np.array([i is not None for i in ids], bool)
        first = self.doc[:max(0, len(start) - WINDOW + 1)]
        at = np.flatnonzero((first == self.doc[WINDOW - 1:]) & known[first])
        h = self._hash(at, _M[:WINDOW])
        order = np.argsort(h, kind="stable")     # documents come by ascending id, so ids ascend within a hash
        h, self.at = h[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.entry = np.cumsum(new) - 1
        self.id = np.array([i or 0 for i in ids], np.int64)[self.doc[self.at]]
        self.hashes, self.least, self._lead = h[new], self.id[new], self.at[new]
        last = np.ones(len(h), bool)
        last[:-1] = new[1:]
        self.several = self.id[last] != self.least

    def _hash(self, at: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j, m in enumerate(multipliers):
            out += self.words[at + j] * m
        return mix64(out)

    def second_hashes(self, entries: np.ndarray) -> np.ndarray:
        """The other 64 bits of the hashes of some entries."""
        return self._hash(self._lead[entries], _M[WINDOW:])

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells touched in a row of 2 ** ``bits``, whether two or more
        documents count there, and each entry's place among the cells."""
        h = mix64(self.hashes ^ (_SALT * np.uint64(row))) if row else self.hashes
        touched, place = np.unique(h >> np.uint64(64 - bits), return_inverse=True)
        count = np.bincount(place, minlength=len(touched)) + np.bincount(place, self.several, len(touched))
        return touched, count > 1, place


def _ranges(cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that sorted cells fall in, and where each begins (with the end)."""
    part = (cells >> np.uint64(bits)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    return part[begins], np.append(begins, len(part))


# ------------------------------------------------------------------ messages
def _planes(x: np.ndarray) -> bytes:
    """Bytes of one significance together: the high ones are mostly zero."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_cells(cells: np.ndarray) -> bytes:
    return zstandard.compress(_planes(np.diff(cells, prepend=np.uint64(0)).astype("<u4")), 1)


def _unpack_cells(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(zstandard.decompress(raw), "<u4"), dtype=np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)],
                                      schema=schema)


_SENT = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("cells", pa.binary()), ("several", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("range", pa.int64()), ("bits", pa.binary())])
_EXACT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("entries", pa.binary())])


def partition_sketches(blocks: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """Each block's count-min sketch: (row, range, block, cells, several)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, words in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "words"))):
                w = Windows(ids, words)
                for row in range(ROWS):
                    cells, several, _ = w.cells(row, bits)
                    parts, ends = _ranges(cells, range_bits)
                    low = np.uint64((1 << range_bits) - 1)
                    yield _table(_SENT, [(row, p, block, _pack_cells(cells[a:b] & low), _bits(several[a:b]))
                                         for p, a, b in zip(parts.tolist(), ends[:-1], ends[1:])])
    return blocks.select("block", "ids", "words").mapInArrow(
        sketch, "row int, range long, block long, cells binary, several binary")


def merge_sketches(sent: DataFrame, range_bits: int) -> DataFrame:
    """For each block's cells of a range, whether the merged count is two or
    more: (block, row, range, bits)."""
    def merge(table: pa.Table) -> pa.Table:
        once = np.zeros(1 << range_bits, bool)
        twice = np.zeros(1 << range_bits, bool)
        got = []
        for cells, several in zip(table["cells"].to_pylist(), table["several"].to_pylist()):
            own = _unpack_cells(cells)
            got.append(own)
            twice[own[once[own] | _flags(several, len(own))]] = True
            once[own] = True
        return pa.Table.from_arrays(
            [table["block"].combine_chunks(), table["row"].combine_chunks(), table["range"].combine_chunks(),
             pa.array([_bits(twice[own]) for own in got], pa.binary())], schema=_REPLY)
    return sent.groupBy("row", "range").applyInArrow(merge, "block long, row int, range long, bits binary")


def _with_replies(blocks: DataFrame, replies: DataFrame, name: str, *keys: str) -> DataFrame:
    own = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*keys, "bits"))).alias(name))
    return blocks.join(own, "block", "left")


def _estimated(w: Windows, replies: list | None, bits: int, range_bits: int) -> np.ndarray:
    """Entries whose merged count is two or more in every row of the sketch."""
    repeated = np.ones(len(w.hashes), bool)
    replies = iter(replies or [])
    for row in range(ROWS):
        cells, _, place = w.cells(row, bits)
        _, ends = _ranges(cells, range_bits)
        flags = [_flags(next(replies)["bits"], b - a) for a, b in zip(ends[:-1], ends[1:])]
        if flags:
            repeated &= np.concatenate(flags)[place]
    return np.flatnonzero(repeated)


def exact_groups(sketched: DataFrame, bits: int, range_bits: int, part_bits: int) -> DataFrame:
    """For the windows of each block that are estimated repeated, whether a
    smaller doc_id of another block holds the window: (block, part, bits)."""
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, words, replies in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "words", "sketch"))):
                w = Windows(ids, words)
                chosen = _estimated(w, replies, bits, range_bits)
                h, g, least = w.hashes[chosen], w.second_hashes(chosen), w.least[chosen]
                parts, ends = _ranges(h, part_bits)
                yield _table(_EXACT, [(p, block, zstandard.compress(h[a:b].tobytes() + g[a:b].tobytes() + _planes(least[a:b]), 1))
                                      for p, a, b in zip(parts.tolist(), ends[:-1], ends[1:])])

    def group(table: pa.Table) -> pa.Table:
        raw = [zstandard.decompress(x) for x in table["entries"].to_pylist()]
        n = [len(x) // 24 for x in raw]
        h, g = (np.concatenate([np.frombuffer(x, np.uint64, k, 8 * k * i) for x, k in zip(raw, n)]) for i in (0, 1))
        ids = np.concatenate([_from_planes(x[16 * k:], "<i8") for x, k in zip(raw, n)])
        order = np.lexsort((g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        smaller = np.empty(len(h), bool)
        smaller[order] = least[np.cumsum(new) - 1] < ids[order]
        ends = np.cumsum([0, *n])
        return pa.Table.from_arrays(
            [table["block"].combine_chunks(), table["part"].combine_chunks(),
             pa.array([_bits(smaller[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["block", "part", "bits"])
    return (sketched.select("block", "ids", "words", "sketch")
            .mapInArrow(candidates, "part long, block long, entries binary")
            .groupBy("part").applyInArrow(group, "block long, part long, bits binary"))


def _cut(w: Windows, removed: np.ndarray) -> np.ndarray:
    """Whether each word of the block lies in a removed window."""
    step = np.zeros(len(w.words) + 1, np.int32)
    np.add.at(step, w.at[removed], 1)
    np.add.at(step, w.at[removed] + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bits: int = RANGE_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space
    (``kept_text``), a row per row of ``docs``."""
    blocks = land(pack(docs, block_bytes), "substring-blocks")
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    bits = max(12, (CELLS * total - 1).bit_length())
    range_bits = min(bits, range_bits)
    part_bits = min(63, 64 + PART_BITS - total.bit_length())
    replies = merge_sketches(partition_sketches(blocks, bits, range_bits), range_bits)
    sketched = _with_replies(blocks, replies, "sketch", "row", "range")
    found = exact_groups(sketched, bits, range_bits, part_bits)
    judged = _with_replies(sketched, found, "exact", "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, sketch, exact in zip(*(batch.column(c).to_pylist() for c in ("ids", "words", "sketch", "exact"))):
                w = Windows(ids, words)
                smaller = np.zeros(len(w.hashes), bool)
                chosen = _estimated(w, sketch, bits, range_bits)
                _, ends = _ranges(w.hashes[chosen], part_bits)
                for a, b, reply in zip(ends[:-1], ends[1:], exact or []):
                    smaller[chosen[a:b]] = _flags(reply["bits"], b - a)
                gone = _cut(w, smaller[w.entry] | (w.id > w.least[w.entry]))
                n, lost = (np.bincount(w.doc, x, len(ids)).astype(np.int64) for x in (None, gone))
                kept, ends = w.text.split(b"\n"), np.cumsum(n)
                for d in np.flatnonzero(lost).tolist():
                    kept[d] = b" ".join(compress(kept[d].split(b" "), (~gone[ends[d] - n[d]:ends[d]]).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n), pa.array(lost), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "n_removed", "kept_text"])
    return (judged.select("ids", "words", "sketch", "exact")
            .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text binary")
            .withColumn("kept_text", F.col("kept_text").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13),
windows AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM places),
judged AS (SELECT r, p, doc_id > min(doc_id) OVER (PARTITION BY s) AS gone FROM windows),
covered AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM judged WHERE gone),
lost AS (SELECT r, list(q) AS qs FROM covered GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN w
              ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(qs, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""
