"""Quality classifier by compression (operator 8).

Two zstandard dictionaries are trained, one on labelled good texts and one on
bad ones.  A text compresses better under the dictionary of what it resembles:
the compressed-size difference, normalised by size, is calibrated to a
probability by logistic regression on labelled texts that neither dictionary
has seen.  The sizes themselves go along, so that texts which both dictionaries
compress to nothing (endless repetition) are told apart as well.

The model is fitted on a bounded sample of labelled rows - ``MAX_LABELLED``
texts per class of at most ``MAX_TRAIN_BYTES`` each, chosen by a hash of the id,
never from the held-out fold.  Scoring reads every whole text.  Labels, lang,
source and doc_id are not inputs of a score.

Defined cases: a null text scores as an empty one; an empty text gets the
calibrated score of sizes 0; without labelled texts of both classes every score
is the smoothed share of good labels (0.5 without any); repeated rows score
alike; labels that contradict each other count by majority, ties as good; null
labels are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import doc_fold, read_table

FOLDS = 5
MAX_LABELLED, MAX_TRAIN_BYTES = 3000, 20_000
DICT_BYTES, LEVEL = 65_536, 3
THRESHOLD = 0.3
SEED = 8


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; too few texts for training serve as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


def _compressor(d: bytes | None) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(d) if d else None
    if own:
        own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own) if own else zstandard.ZstdCompressor(level=LEVEL)


@dataclass
class Model:
    """Dictionaries and calibration; ``score`` needs nothing else."""
    good: bytes = b""
    bad: bytes = b""
    prior: float = 0.5
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def features(self, texts: list[bytes]) -> np.ndarray:
        tools = [_compressor(d) for d in (self.good, self.bad, None)]
        sizes = np.array([[len(c.compress(t)) for c in tools] + [len(t)] for t in texts], dtype=float).reshape(-1, 4)
        g, b, plain, n = sizes.T
        return np.stack([(b - g) / (b + g), (b - g) / (n + 1), g / (n + 1), plain / (n + 1), np.log1p(n)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with damped steps on a ridge-penalised likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str = "quality") -> list:
    """(text, label, part) of the bounded sample; part 0 trains dictionaries,
    part 1 the calibration."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id")
           .agg((F.avg(target) >= 0.5).cast("int").alias("y")).where(doc_fold(F.col("doc_id"), FOLDS) != 0)
           .withColumn("h", F.xxhash64("doc_id", F.lit(SEED))))
    picked = [one.where(F.col("y") == y).orderBy("h", "doc_id").limit(MAX_LABELLED) for y in (0, 1)]
    chosen = picked[0].union(picked[1])           # at most 2 * MAX_LABELLED rows: safe to broadcast
    text = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).where(
        (F.octet_length("text") > 0) & (F.octet_length("text") <= MAX_TRAIN_BYTES))
    rows = text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], bytes(r["text"])))
    return [(bytes(r["text"]), r["y"], i % 2) for y in (0, 1) for i, r in enumerate(x for x in rows if x["y"] == y)]


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    rows = labelled_sample(docs, labels, target)
    by = {(y, part): [t for t, yy, pp in rows if (yy, pp) == (y, part)] for y in (0, 1) for part in (0, 1)}
    n = len(rows)
    prior = (sum(y for _, y, _ in rows) + 1) / (n + 2)
    if not all(by.values()):
        return Model(prior=prior)
    model = Model(_dictionary(by[1, 0]), _dictionary(by[0, 0]), prior)
    held = [(t, y) for y in (0, 1) for t in by[y, 1]]
    x, y = model.features([t for t, _ in held]), np.array([y for _, y in held], dtype=float)
    model.mean, model.scale = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    model.weights = _logistic((x - model.mean) / model.scale, y).tolist()
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted; other columns of these
    names give way."""
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode() for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(texts), pa.float64())],
                                             [*b.schema.names, "score"])
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    own = docs.columns
    return with_scores(docs, fit(docs, labels)).where("predicted = 1").select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return with_scores(docs, model).select(
        "doc_id", (doc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
