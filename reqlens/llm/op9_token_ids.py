"""Token-ID binary output (operator 9).

Documents are range-partitioned in ascending ``doc_id`` order; each partition
is tokenised and becomes one shard file.  A shard file is a run of frames, and
a frame holds the concatenated ids of consecutive documents together with the
Elias-Fano code of their boundaries, so any document's offsets come from a
select on the code and no 64-bit offset table is stored.

Frame (little-endian):

====== ===================================================================
bytes  content
====== ===================================================================
4      magic ``EFT1``
4      id width in bytes (2 or 4)
8      documents d
8      ids n (end ids included)
4      low bits per boundary l
4      words of the high bit vector h
d*8    doc ids, two's complement (0 where null)
ceil(d/8)   bitmap of null doc ids
ceil(d*l/8) low bits of the boundaries
h*8    high bits: bit ``(boundary_i >> l) + i`` is set
n*w    ids
====== ===================================================================

Boundaries are the d end offsets within the frame.  The files are written by
Spark's text writer, one binary value per frame, so its commit protocol covers
lost executors, repeated tasks and any file system Spark can write to; every
frame is therefore followed by one newline byte.  ``manifest`` has one row per
shard: documents, ids and the ids before it.

Defined cases: a null or empty text has the end id only; null ids come first;
repeated rows are each written (ties in doc_id are ordered by a hash of the
text); an empty table gives no shard and no rows; extra columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reqlens.llm.common import land, partitions, read_table, scratch, small_batches
from reqlens.llm.tokens import SLICE, Encoder

MAGIC = b"EFT1"
#: a frame is closed at this many ids (a longer document has a frame of its own)
FRAME_IDS = 1 << 20
HEADER = struct.Struct("<4sIQQII")


# ---------------------------------------------------------------- Elias-Fano
def ef_encode(bounds: np.ndarray, universe: int) -> tuple[int, bytes, np.ndarray]:
    """(low bits each, packed low bits, high words) of a non-decreasing array."""
    d = len(bounds)
    low = max(0, int(universe // max(d, 1)).bit_length() - 1)
    b = bounds.astype(np.uint64)
    high = np.zeros(((d + (universe >> low)) >> 6) + 1, dtype=np.uint64)
    pos = (b >> np.uint64(low)) + np.arange(d, dtype=np.uint64)
    np.bitwise_or.at(high, (pos >> np.uint64(6)).astype(np.int64), np.uint64(1) << (pos & np.uint64(63)))
    bits = ((b[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return low, np.packbits(bits.ravel(), bitorder="little").tobytes(), high


def ef_select(low: int, lows: bytes, high: np.ndarray, d: int, idx: np.ndarray | None = None) -> np.ndarray:
    """Values number ``idx`` (all by default): select of the idx-th set bit
    through popcounts of the high words, then the low bits."""
    idx = np.arange(d, dtype=np.int64) if idx is None else np.asarray(idx, dtype=np.int64)
    counts = np.cumsum(np.bitwise_count(high).astype(np.int64))
    word = np.searchsorted(counts, idx, side="right")
    before = np.where(word > 0, counts[np.maximum(word - 1, 0)], 0)
    bits = ((high[word][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    inside = np.argmax(np.cumsum(bits, axis=1) == (idx - before + 1)[:, None], axis=1)
    top = ((word.astype(np.int64) << 6) + inside - idx).astype(np.uint64) << np.uint64(low)
    if not low:
        return top.astype(np.int64)
    flat = np.unpackbits(np.frombuffer(lows, dtype=np.uint8), bitorder="little", count=d * low).reshape(d, low)[idx]
    return (top | (flat.astype(np.uint64) << np.arange(low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


# ------------------------------------------------------------------- frames
def frame(doc_ids: list, pieces: list[bytes], width: int) -> bytes:
    ends = np.cumsum([len(p) // width for p in pieces], dtype=np.int64)
    n, d = int(ends[-1]), len(pieces)
    low, lows, high = ef_encode(ends, n)
    null = np.array([x is None for x in doc_ids], dtype=np.uint8)
    ids = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    return b"".join([HEADER.pack(MAGIC, width, d, n, low, len(high)), ids.tobytes(),
                     np.packbits(null, bitorder="little").tobytes(), lows, high.astype("<u8").tobytes(), *pieces])


def read_frames(buf: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, null flags, end offsets, ids) of each frame of a shard file."""
    at = 0
    while at < len(buf):
        magic, width, d, n, low, words = HEADER.unpack_from(buf, at)
        if magic != MAGIC:
            raise ValueError(f"not a frame at byte {at}")
        at += HEADER.size
        ids = np.frombuffer(buf, "<i8", d, at); at += 8 * d
        null = np.unpackbits(np.frombuffer(buf, np.uint8, (d + 7) // 8, at), bitorder="little", count=d); at += (d + 7) // 8
        size = (d * low + 7) // 8
        lows = bytes(buf[at:at + size]); at += size
        high = np.frombuffer(buf, "<u8", words, at); at += 8 * words
        toks = np.frombuffer(buf, f"<u{width}", n, at); at += width * n + 1
        yield ids, null.astype(bool), ef_select(low, lows, high, d), toks


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Write ``docs`` (doc_id, text) as shard files under ``path``."""
    shards = shards or partitions(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        ids, pieces, n = [], [], 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            own = batch.column(0).to_pylist()
            for doc_id, piece in zip(own, enc.encode_bytes(batch.column(1).to_pylist())):
                ids.append(doc_id)
                pieces.append(piece + end)
                n += len(pieces[-1]) // enc.width
                if n >= FRAME_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([frame(ids, pieces, enc.width)], pa.binary())], ["frame"])
                    ids, pieces, n = [], [], 0
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([frame(ids, pieces, enc.width)], pa.binary())], ["frame"])

    frames = ordered.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        frames.write.option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    # part-00012-<job id>: the number is the shard's place in doc_id order
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .withColumn("shard", F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int")))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: shard, doc_id, position and offset
    within the shard, n_tokens and the CRC of its ids as 32-bit integers."""
    schema = "shard int, place long, doc_id long, offset long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                base = place = 0
                for ids, null, ends, toks in read_frames(memoryview(content.as_buffer())):
                    starts = np.concatenate([[0], ends[:-1]])
                    wide = toks.astype("<u4")
                    crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    d = len(ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(d, shard, np.int32)), pa.array(np.arange(place, place + d)),
                        pa.array(ids, mask=null), pa.array(starts + base), pa.array(ends - starts),
                        pa.array(np.array(crcs, dtype=np.int64))],
                        ["shard", "place", "doc_id", "offset", "n_tokens", "ids_crc32"])
                    base += int(ends[-1]); place += d
    return _files(spark, path).select("shard", "content").mapInArrow(decode, schema)


def manifest(rows: DataFrame) -> DataFrame:
    """Documents and ids per shard and the ids before it (a row per file)."""
    per = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files, read them back, and return the digest per document."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-ids")
    write_shards(docs, path, tokenizer, end_id)
    rows = land(read_shards(spark, path), "token-rows")
    return (rows.join(manifest(rows).select("shard", "ids_before"), "shard")
            .select("doc_id", (F.col("offset") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32", "shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
