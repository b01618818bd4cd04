"""Helpers shared by the training-data operators.

Every operator takes whole texts.  A *word* is a maximal run of characters
other than space and U+0009..U+000D; that set is exactly what ``bytes.split()``
separates on, so Python tasks split UTF-8 bytes and SQL uses ``WORD``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.session import ensure_checkpoint_dir

#: a word, in the syntax of Java and RE2 regular expressions
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (shared by all executors)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: rows of an Arrow batch while this library writes; Spark's 10,000 whole texts would be tens of MB, held by both sides
ARROW_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Spark's Arrow batches are small for the writes inside, and as before after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later
    steps do not compute it again, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed = path
    return out


def drop_landed(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`land` that nothing reads
    any more."""
    path = getattr(df, "_landed", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty one."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null ids: fold 0, so
    they are never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finishing step: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


#: distinct words whose hashes a worker remembers; at the bound the memory starts afresh
WORD_CACHE = 250_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words.  All operators of a worker share one memory."""
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
