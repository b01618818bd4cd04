"""Edit-aware token counts (operator 3).

A document's pre-tokens are cut into leaves of ``LEAF``; a segment tree over the
leaves keeps the sums of their characters and tokens.  An edit descends the tree
to the leaves it touches; those are cut into pre-tokens anew together with
boundary context, only their tokens are counted again, and only the sums above
them change.  Counts always equal those of a full encoding of the edited text.

Context: the region begins at a leaf before the edit that holds a character
other than white space (a cut there cannot depend on the edit) and ends at the
first leaf end where the new cuts meet an old one; from there on both agree,
because the pre-token pattern never looks back.

Trees are two array columns per document and are kept in tables like any other
column.  Nothing is shuffled.

Defined cases: null and empty texts have an empty tree and 0 tokens, and edits
may insert into them; edits of one document must not overlap; of edits at one
place, zero-length ones come first; repeated rows are counted each; an empty
table gives an empty table; extra columns are kept by the operators.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.common import read_table
from reqlens.llm.op6_pii import base_spans

LEAF = 64
#: distinct pre-tokens whose counts a worker remembers
CACHE = 500_000
#: replacements of the query's redactions
MASK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens and their token counts for one vocabulary."""

    _made: dict[tuple[str, str], Counter] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Counter:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        # a task is one core's: the library's own threads would spin on the cores of the other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True        # special strings in a text are ordinary text
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def counts(self, pre: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = [x for x in set(pre) if x not in known]
        if new:
            known.update(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False))))
        return np.fromiter(map(known.__getitem__, pre), np.int32, len(pre))

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) per leaf of a whole text."""
        pre = self.cut(text)
        if not pre:
            return np.empty(0, np.int32), np.empty(0, np.int32)
        at = np.arange(0, len(pre), LEAF)
        size = np.fromiter(map(len, pre), np.int32, len(pre))
        return np.add.reduceat(size, at).astype(np.int32), np.add.reduceat(self.counts(pre), at).astype(np.int32)


class Tree:
    """Sums over leaves: node i has children 2i and 2i+1, leaf j is node n+j."""

    def __init__(self, values: np.ndarray):
        self.n = 1 << max(0, len(values) - 1).bit_length()
        self.sums = np.zeros(2 * self.n, np.int64)
        self.sums[self.n:self.n + len(values)] = values
        level = self.n
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level = half

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def set(self, leaf: int, value: int) -> None:
        i = self.n + leaf
        change = value - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds position ``at``."""
        i, before = 1, 0
        while i < self.n:
            i *= 2
            if at >= before + self.sums[i]:
                before += int(self.sums[i])
                i += 1
        return i - self.n, before


def apply_edits(counter: Counter, text: str, chars: np.ndarray, tokens: np.ndarray,
                edits: list[Edit]) -> tuple[str, np.ndarray, np.ndarray, int, int]:
    """(new text, its leaf characters, leaf tokens, token count, characters
    encoded again).  Leaves keep their number, so the tree keeps its shape."""
    edits = sorted(edits, key=lambda e: (e[0], e[1]))
    if not len(chars):
        new = "".join(r for _, _, r in edits)
        c, t = counter.leaves(new)
        return new, c, t, int(t.sum()), len(new)
    size, sums = Tree(chars), Tree(tokens)
    chars, tokens = chars.copy(), tokens.copy()
    start = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    last = len(chars) - 1
    solid = lambda i: not text[start[i]:start[i + 1]].isspace() and start[i] < start[i + 1]

    # regions of touched leaves with one solid leaf of context before them
    regions: list[list] = []
    for e in edits:
        lo = min(size.find(max(0, e[0] - 1))[0], last)
        hi = min(size.find(max(e[0], e[1] - 1))[0], last)
        lo -= lo > 0
        while lo > 0 and not solid(lo):
            lo -= 1
        if regions and lo <= regions[-1][1] + 1:
            regions[-1][1] = max(hi, regions[-1][1])
            regions[-1][2].append(e)
        else:
            regions.append([lo, hi, [e]])
    out, done, again, k = [], 0, 0, 0
    while k < len(regions):
        lo, hi, own = regions[k]
        ahead = min(hi + 1, last)                     # text beyond the region that the cuts may look at
        while ahead < last and not solid(ahead):
            ahead += 1
        if k + 1 < len(regions) and ahead >= regions[k + 1][0]:
            regions[k + 1] = [lo, regions[k + 1][1], own + regions[k + 1][2]]
            k += 1
            continue
        a, b = int(start[lo]), int(start[hi + 1])
        pieces, at = [], a
        for s, e, r in own:
            pieces += [text[at:s], r]
            at = e
        body = "".join(pieces) + text[at:b]
        pre = counter.cut(body + text[b:int(start[ahead + 1])])
        ends = np.cumsum([len(x) for x in pre])
        n = int(np.searchsorted(ends, len(body), "right")) if len(body) else 0
        if hi < last and len(body) and (n == 0 or ends[n - 1] != len(body)):
            regions[k][1] = hi + 1                    # no cut at the region's end yet
            continue
        pre = pre[:n]
        got = counter.counts(pre)
        again += len(body)
        cuts = np.linspace(0, n, hi - lo + 2).astype(int)
        for j, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            chars[lo + j], tokens[lo + j] = sum(map(len, pre[x:y])), int(got[x:y].sum())
            sums.set(lo + j, int(tokens[lo + j]))
        out += [text[done:a], body]
        done = b
        k += 1
    return "".join(out) + text[done:], chars, tokens, sums.total, again


# -------------------------------------------------------------------- Spark
def _append(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` plus n_tokens and the tree's leaves, leaf_chars and leaf_tokens."""
    docs = docs.drop("n_tokens", "leaf_chars", "leaf_tokens")
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("leaf_chars", ints), T.StructField("leaf_tokens", ints)])
    at = docs.columns.index("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path, pattern)
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            trees = [counter.leaves(t or "") for t in b.column(at).to_pylist()]
            yield _append(b, ["n_tokens", "leaf_chars", "leaf_tokens"],
                          [pa.array([int(t.sum()) for _, t in trees], pa.int64()),
                           pa.array([c for c, _ in trees], pa.list_(pa.int32())),
                           pa.array([t for _, t in trees], pa.list_(pa.int32()))])
    return docs.mapInArrow(build, schema)


def recount(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """Apply the column ``edits`` (array of start, end, replacement) to texts
    and trees; adds n_tokens_before, n_edits and reencoded_chars."""
    extra = ("n_tokens_before", "n_edits", "reencoded_chars")
    trees = trees.drop(*extra)
    schema = T.StructType([*trees.schema.fields, *[T.StructField(c, T.LongType()) for c in extra]])
    names = trees.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path, pattern)
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            col = {c: b.column(i).to_pylist() for i, c in enumerate(names) if c in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "edits")}
            done = []
            for text, c, t, n, edits in zip(col["text"], col["leaf_chars"], col["leaf_tokens"], col["n_tokens"], col["edits"]):
                if edits:
                    todo = [(e["start"], e["end"], e["replacement"] or "") for e in edits]
                    done.append((*apply_edits(counter, text or "", np.array(c, np.int32), np.array(t, np.int32), todo), n, len(todo)))
                else:
                    done.append((text, c, t, n, 0, n, 0))
            new = {"text": pa.array([d[0] for d in done], pa.string()), "leaf_chars": pa.array([d[1] for d in done], pa.list_(pa.int32())),
                   "leaf_tokens": pa.array([d[2] for d in done], pa.list_(pa.int32())), "n_tokens": pa.array([d[3] for d in done], pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [*[new.get(c, b.column(i)) for i, c in enumerate(names)],
                 *[pa.array([d[i] for d in done], pa.int64()) for i in (5, 6, 4)]], [*names, *extra])
    return trees.mapInArrow(run, schema)


def cleaning_edits(text: str) -> list[Edit]:
    """The query's edits: personal data masked, and lines equal to an earlier
    line removed (with their line break)."""
    spans = sorted((s, e, MASK[k]) for k, s, e in base_spans(text))
    seen, at, edits = set(), 0, []
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((max(0, at - 1), at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    return _disjoint(sorted(edits + spans))


def _disjoint(edits: list[Edit]) -> list[Edit]:
    """Of overlapping edits, the first."""
    out: list[Edit] = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def with_cleaning_edits(docs: DataFrame) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("edits", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())])))])
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"start": s, "end": e, "replacement": r} for s, e, r in cleaning_edits(t or "")]
                    for t in b.column(at).to_pylist()]
            yield _append(b, ["edits"], [pa.array(rows, kind)])
    return docs.mapInArrow(find, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after cleaning edits."""
    import public_tokenizers as tokenizers
    path, pattern = tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = recount(with_cleaning_edits(build_trees(docs, path, pattern)), path, pattern)
    return done.select("doc_id", "n_tokens_before", "n_edits", "n_tokens", F.size("leaf_chars").cast("long").alias("n_leaves"),
                       "reencoded_chars")
