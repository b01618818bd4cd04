"""MinHash near-duplicates by a signature-coordinate inverted join (operator 4).

1. Every text becomes its set of distinct 5-word shingles, a fingerprint of the
   set and a MinHash signature.  Documents of equal sets form one *node*.
2. Nodes are posted under their first ``INDEX`` coordinate-value pairs.  Two
   nodes similar enough agree on at least ``index_matches`` of them (but for a
   miss rate of ``MISS``), so, pairs being ordered by posting-list length, they
   share one of the ``INDEX - index_matches + 1`` rarest (prefix merging).
   Pairs that one node alone holds are never posted; long lists come last in
   every prefix and are mostly skipped.
3. Lists are merged without expanding them: every list compares its members
   with a few leaders, and linked nodes become one component.  What is left -
   members of different components in one list - is compared in blocks
   by counting equal coordinates.  Members of a list's largest component are
   never compared with each other: their blocks meet only those of the others.
4. Every retained pair is confirmed on the full shingle sets.

Postings and blocks are spread by (pair, block), so one huge group of near
copies is many small tasks; exact copies are one node however many they are.

Defined cases: null, empty and blank texts have no shingles and stand alone; a
text of 1-4 words is one shingle of its whole sequence; rows with text that share a
``doc_id`` are one document (an empty one of them stands alone); a null ``doc_id`` is linked with nothing, has a
null component and is kept; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import hash_words, land, mix64, partitions, read_table
from reqlens.llm.components import components

WORDS = 5
#: similarity of a link, as a fraction
NUM, DEN = 75, 100
SIGNATURE, INDEX = 128, 32
#: share of true links at the threshold that a signature test may miss
MISS = 1e-5
#: leaders that every posting list compares its members with
LEADERS = 3
#: a block of a posting list: at most about so many members and shingles (two blocks are compared in one task)
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                             0x8EBC6AF09C88C6E3)]


@cache
def least_matches(k: int, miss: float = MISS) -> int:
    """Largest m such that fewer than m of k coordinates agree with
    probability at most ``miss`` when a pair is just similar enough."""
    p, below = NUM / DEN, 0.0
    for m in range(k + 1):
        below += comb(k, m) * p**m * (1 - p)**(k - m)
        if below > miss:
            return m
    return k


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=1 + len(h))], np.uint64)
    n = len(h) - WORDS + 1
    s = h[:n] * _P[0]
    for j in range(1, WORDS):
        s += h[j:j + n] * _P[j]
    return np.unique(mix64(s))


def _multipliers() -> np.ndarray:
    return mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * _P[0]) | np.uint64(1)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit coordinates per non-empty set."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((SIGNATURE, len(sets)), np.uint32)
    buf = np.empty_like(flat)
    for k, a in enumerate(_multipliers()):
        np.multiply(flat, a, out=buf)
        out[k] = np.minimum.reduceat(buf, at) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal sizes as a matrix of 32-bit integers."""
    return np.frombuffer(b"".join(x.as_py() for x in col), np.uint32).reshape(len(col), width)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_id and signature (null where the set is empty)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sets = [shingles(x.as_py()) for x in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                ids: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, _signatures([sets[i] for i in full])):
                        ids[i], sigs[i] = _fingerprint(sets[i]), row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(sigs, pa.binary())], ["doc_id", "n", "set_id", "sig"])
    return (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(sign, "doc_id long, n long, set_id binary, sig binary"))


def _postings(nodes: DataFrame) -> DataFrame:
    """(pair, node): each node under the rarest of its shared pairs, as many as
    the prefix bound asks for."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coord = np.arange(INDEX, dtype=np.int64) << 32
        for b in batches:
            sig = _matrix(b.column(1), SIGNATURE)[:, :INDEX].astype(np.int64)
            node = np.repeat(b.column(0).to_numpy(), INDEX)
            yield pa.RecordBatch.from_arrays([pa.array((sig + coord).ravel()), pa.array(node)], ["pair", "node"])
    posted = nodes.select("node", "sig").mapInArrow(spread, "pair long, node long")
    shared = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    prefix = INDEX - least_matches(INDEX) + 1
    held = (posted.join(shared, "pair").groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("len", "pair"))).alias("held")))   # at most INDEX entries
    cut = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.lit(prefix - INDEX) + F.size("held")))
    return held.select("node", F.explode(cut).alias("x")).select(F.col("x.pair").alias("pair"), "node")


def _enough_matches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree on enough coordinates."""
    least = least_matches(SIGNATURE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column(2), SIGNATURE) == _matrix(b.column(3), SIGNATURE)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same >= least))
    sig = nodes.select("node", "sig")
    return (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with ``linked``: the exact test on full shingle sets."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                i = int((both[1:] == both[:-1]).sum())
                ok.append(DEN * i >= NUM * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("ha")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("hb")), "b")
            .select("a", "b", "ha", "hb").mapInArrow(test, "a long, b long, linked boolean"))


def _node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes (node, set_id, doc_id)."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                node, out = [], []
                for n, set_id, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    s = shingles(text.as_py())
                    if _fingerprint(s) == set_id.as_py():    # not the other text of a repeated id
                        node.append(n)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], ["node", "shingles"])
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return (nodes.join(text, "doc_id").select("node", "set_id", "text").mapInArrow(collect, "node long, shingles binary")
            .dropDuplicates(["node"]))


def _oriented(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _star_pairs(postings: DataFrame) -> DataFrame:
    """Each member of a list with the list's leaders, which are the members
    with the least of LEADERS seeded hashes."""
    lead = postings.groupBy("pair").agg(
        *[F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node")).alias(f"l{i}") for i in range(LEADERS)])
    met = postings.join(lead, "pair").select(
        "node", F.explode(F.array_distinct(F.array(*[F.col(f"l{i}.node") for i in range(LEADERS)]))).alias("lead"))
    return _oriented(met.where("node <> lead"), "node", "lead")


def _by_group(compare, names: list[str], kinds: list[pa.DataType]):
    """A mapInArrow function over rows sorted by their first three columns:
    ``compare(group)`` gives the columns of each group's result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []        # rows of the group that the last batch left open
        key = None

        def close() -> pa.RecordBatch:
            cols = compare(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                k = tuple(keys[:, s].tolist())
                if held and k != key:
                    yield close()
                    held = []
                key = k
                held.append(b.slice(s, e - s))
        if held:
            yield close()
    return run


def _partners(table: pa.Table):
    """For each row of a block that takes part in comparisons: (row, the rows
    it is compared with).  Rows of one component are not compared."""
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    own, node, comp = (table.column(c).to_numpy() for c in ("own", "node", "comp"))
    for i in range(len(node)):
        if lo == hi or own[i] == lo:
            other = np.flatnonzero((comp != comp[i]) & ((own != own[i]) if lo < hi else (node > node[i])))
            if len(other):
                yield i, other


def _candidates(table: pa.Table) -> list:
    """Rows of a block with some partner that agrees on enough coordinates.  A
    pair is counted in the first list it shares only."""
    least, coord = least_matches(SIGNATURE), table.column("pair")[0].as_py() >> 32
    sig, mask = _matrix(table.column("sig").combine_chunks(), SIGNATURE), table.column("mask").to_numpy()
    hit = np.zeros(table.num_rows, bool)
    for i, other in _partners(table):
        other = other[(sig[other] == sig[i]).sum(axis=1) >= least]
        if len(other):
            common = mask[other] & mask[i] & ((1 << coord) - 1)
            early = ((sig[other, :INDEX] == sig[i, :INDEX]) & ((common[:, None] >> np.arange(INDEX)) & 1).astype(bool)).any(axis=1)
            hit[other[~early]] = True
            hit[i] |= not early.all()
    rows = table.filter(pa.array(hit))
    return [rows.column(c).combine_chunks() for c in ("pair", "lo", "hi", "own", "node", "comp")]


def _exact_links(table: pa.Table) -> list:
    """The pairs of a block that are similar enough, by full shingle sets."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    size = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at, node, found = np.cumsum(size) - size, table.column("node").to_numpy(), []
    for i, other in _partners(table):
        mark = np.zeros(len(words), np.int32)
        mark[flat[at[i]:at[i] + size[i]]] = 1
        both = np.add.reduceat(mark[flat], at)[other]
        found += [(int(node[i]), int(x)) for x in node[other[DEN * both >= NUM * (size[i] + size[other] - both)]]]
    return [[min(x) for x in found], [max(x) for x in found]]


def _block_links(postings: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one list but of different components.  Lists
    are cut into blocks; a pair of blocks is compared in one task, first by
    signatures, then - nodes with a candidate only - by their shingle sets, so
    what leaves the tasks is nodes and links, never pairs of candidates."""
    n_parts = partitions(postings.sparkSession)
    known = nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"))
    p = postings.join(known, "node")
    size = (p.groupBy("pair", "comp").agg(F.count(F.lit(1)).alias("len"), F.sum("n").alias("n")).groupBy("pair")
            .agg(F.count(F.lit(1)).alias("comps"), F.sum("len").alias("len"), F.sum("n").alias("n"),
                 F.max(F.struct("len", "n", "comp")).alias("big")).where("comps > 1 and len > 2"))

    def blocks(rows: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    split = blocks(F.col("len"), F.col("n")) > 1
    mixed = size.select(
        "pair", F.col("big.comp").alias("big"),
        F.when(split, blocks(F.col("len") - F.col("big.len"), F.col("n") - F.col("big.n"))).otherwise(1).alias("loose"),
        F.when(split, blocks(F.col("big.len"), F.col("big.n"))).otherwise(0).alias("settled"))
    mask = postings.groupBy("node").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftright(pair, 32) as int))")).alias("mask"))
    # blocks 0 .. loose - 1 hold the members outside the largest component, the next ones that component
    inner = (F.col("comp") == F.col("big")) & (F.col("settled") > 0)
    h = F.xxhash64("node")
    own = F.when(inner, F.col("loose") + F.pmod(h, F.col("settled"))).otherwise(F.pmod(h, F.col("loose"))).cast("int")
    last = F.when(inner, F.col("loose") - 1).otherwise(F.col("loose") + F.col("settled") - 1)
    rows = (p.join(mixed, "pair").withColumn("own", own).withColumn("last", last)
            .join(mask, "node").join(nodes.select("node", "sig"), "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
            .select("pair", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                    "own", "node", "comp", "mask", "sig"))

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(n_parts, "pair", "lo", "hi").sortWithinPartitions("pair", "lo", "hi")
    key = ["pair", "lo", "hi", "own", "node", "comp"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    near = grouped(rows).mapInArrow(_by_group(_candidates, key, kinds),
                                    "pair long, lo int, hi int, own int, node long, comp long")
    return (grouped(near.join(sets, "node").select(*key, "shingles"))
            .mapInArrow(_by_group(_exact_links, ["a", "b"], [pa.int64()] * 2), "a long, b long").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    sets = land(document_sets(docs), "minhash-sets")
    nodes = land(sets.where("set_id is not null and doc_id is not null").groupBy("set_id")
                 .agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n").alias("n"))
                 .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    # (doc_id, node) of every row; rows of one id but different texts join their nodes
    member = land(sets.where("doc_id is not null").drop("sig")
                  .join(nodes.select("set_id", "node"), "set_id", "left").select("doc_id", "n", "node"), "minhash-members")
    least = member.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    edges = member.join(least, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct()

    postings = land(_postings(nodes), "minhash-postings")
    texts = land(_node_sets(docs, nodes.join(postings.select("node").distinct(), "node", "left_semi").select("node", "set_id", "doc_id")),
                 "minhash-shingles")
    edges = land(edges, "minhash-edges")
    stars = land(_confirmed(_enough_matches(_star_pairs(postings), nodes), texts), "minhash-links")
    edges = edges.union(stars.where("linked").select("a", "b"))
    more = land(_block_links(postings, components(edges), nodes, texts), "minhash-links")
    labels = components(edges.union(more))
    least_doc = (nodes.select("node", "doc_id").join(labels, "node").groupBy("comp")
                 .agg(F.min("doc_id").alias("component")))
    root = labels.join(least_doc, "comp").select("node", "component")
    single = nodes.select("node", F.col("doc_id").alias("own"))
    found = (member.join(single, "node", "left").join(root, "node", "left")
             .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "own", "doc_id").alias("component_id")))
    # null ids stand alone
    nameless = sets.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"),
                                                   F.lit(None).cast("long").alias("component_id"))
    return found.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the least id (once, should its
    row be repeated)."""
    ids = near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
