"""Prefix trie of conversations by time-forward processing (operator 13).

Rebuilt conversations (see ``rebuild``) share prefixes; a node is a distinct
sequence of first turns.  A prefix is known by its depth and by a fingerprint
that composes (a polynomial over 128-bit turn digests modulo a 127-bit prime),
so prefixes of a conversation of any length are computed piece by piece.

1. ``number_turns``: turns, as digests, are sorted over the whole table by
   (conversation, turn) and numbered inside each partition; only conversations that cross partitions
   get a carry, at most two rows a partition.
2. ``rebuild``: a conversation's own turns after its head join at most eight turns
   of its base.
3. Nodes are counts over (conversation, depth) rows, summed on the map side.
   A node's ``weight``, the rows in its subtree, bounds the nodes below it.
4. Time-forward processing.  *Shards* are the largest subtrees of weight at most
   ``SHARD``.  Their nodes are sorted by reverse level order (Spark's external sort);
   each node takes its children's totals from a priority queue that
   spills, and sends its own total to its parent.  Then across shard roots: the nodes
   above the shards take the sums of their shard roots and form paths of
   at most ``SHARD`` nodes by least member; each path is processed the same way, the
   paths' roots as one small tree, and each path once more with the totals that
   come in from the side.

No task holds a subtree: a shard is bounded, and a queue keeps ``QUEUE`` messages in memory.
The tree of paths (one node per path, no texts) is the only thing that passes through one task, sorted
and streamed.  A digest of member ids is sequential by nature; it is fed from sorted chunks of ids.

Defined cases: rows with a null conv_id take no part; a null role or text is
empty; turns of one conversation with the same number, and repeated rows, follow each other
in the order of an MD5 of role and text; ids are divided as SQL does (towards zero); an empty table
gives an empty one; totals that a long cannot hold raise; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm.common import land, read_table

#: heads are taken from conversation c - c % GROUP and have crc32(c) % HEADS turns
GROUP, HEADS = 5, 9
#: rows in a shard's subtree, and nodes of a path above the shards
SHARD = 1 << 14
#: messages that a queue keeps in memory
QUEUE = 1 << 17
#: ids in a chunk of a digest
CHUNK_BITS = 12
_P = (1 << 127) - 1
_B = int.from_bytes(hashlib.sha256(b"base of prefix fingerprints").digest(), "big") % _P
ROOT = bytes(16)


# ------------------------------------------------------------ fingerprints
@cache
def _small_power(k: int) -> int:
    return pow(_B, k, _P)


def _power(k: int) -> int:
    return _small_power(k) if k < 4096 else pow(_B, k, _P)


def _int(raw: bytes | None) -> int:
    return int.from_bytes(raw or ROOT, "big")


def _raw(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _join(left: int, right: int, n: int) -> int:
    """Fingerprint of two sequences after each other, the second of n turns."""
    return (left * _power(n) + right) % _P


def _map(df: DataFrame, ddl: str, row) -> DataFrame:
    """``row`` (a tuple to a tuple) over the rows of ``df``, batch by batch."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    types = [kinds[c.split()[1]] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            out = [row(x, state) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names)
    return df.mapInArrow(run, ddl)


# ------------------------------------------------------------- turns in order
def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), the fingerprints of the first pos - 1 and pos
    turns (prev, fp) and n_bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = (conversations.where("conv_id IS NOT NULL")
             .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                     F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
                     F.octet_length(text).cast("long").alias("n_bytes")))
    order = ("conv_id", F.col("turn").asc_nulls_first(), "digest")

    def number(x: tuple, state: dict) -> tuple:
        conv_id, digest, n_bytes = x
        if state.get("conv") != conv_id:
            state |= {"conv": conv_id, "pos": 0, "fp": 0}
        prev = state["fp"]
        state["pos"] += 1
        state["fp"] = _join(prev, int(digest, 16) % (_P - 1) + 1, 1)
        return conv_id, TaskContext.get().partitionId(), state["pos"], _raw(prev), _raw(state["fp"]), n_bytes
    local = land(_map(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes"),
                      "conv_id long, part long, pos long, prev binary, fp binary, n_bytes long", number), "turns")
    # a conversation has one piece per partition it reaches into
    pieces = (local.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by("fp", "pos").alias("fp"))
              .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "fp"))).alias("pieces"))
              .where(F.size("pieces") > 1))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, own in zip(*(c.to_pylist() for c in batch.columns)):
                n = fp = 0
                for p in own:
                    out.append((conv_id, p["part"], n, _raw(fp)))
                    n, fp = n + p["n"], _join(fp, _int(p["fp"]), p["n"])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)],
                                             ["conv_id", "part", "n_before", "fp_before"])
    before = pieces.mapInArrow(carry, "conv_id long, part long, n_before long, fp_before binary")

    def place(x: tuple, _: dict) -> tuple:
        conv_id, pos, prev, fp, n_bytes, n, left = x
        if not n:
            return conv_id, pos, prev, fp, n_bytes
        return conv_id, pos + n, _raw(_join(_int(left), _int(prev), pos - 1)), _raw(_join(_int(left), _int(fp), pos)), n_bytes
    # at most two rows per partition of the sort: its first and its last conversation
    return _map(local.join(F.broadcast(before), ["conv_id", "part"], "left")
                .select("conv_id", "pos", "prev", "fp", "n_bytes", "n_before", "fp_before"),
                "conv_id long, pos long, prev binary, fp binary, n_bytes long", place)


def rebuild(conversations: DataFrame) -> DataFrame:
    """Rebuilt conversations as rows (conv_id, length, depth, key, parent,
    n_bytes), a row for depth 0 included: the first h turns of conversation
    c - c % GROUP, then c's own turns after its first h; h = crc32(c) % HEADS."""
    turns = land(number_turns(conversations).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS), "turns")
    heads = (turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "prev", "fp", "n_bytes"))).alias("heads")))
    head_n = F.least("h", F.coalesce(F.size("heads"), F.lit(0)))
    convs = land(turns.groupBy("conv_id").agg(F.first("h").alias("h"), F.max("pos").alias("n"),
                                              F.max(F.when(F.col("pos") == F.col("h"), F.col("fp"))).alias("own_head"))
                 .withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "base", "left")
                 .withColumn("heads", F.when(head_n > 0, F.slice("heads", 1, head_n.cast("int"))))
                 .withColumn("head_n", F.coalesce(F.size("heads"), F.lit(0)).cast("long"))
                 .withColumn("length", F.col("head_n") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    taken = (convs.select("conv_id", "length", F.explode("heads").alias("t"))
             .select("conv_id", "length", F.col("t.pos").alias("depth"), F.col("t.fp").alias("key"), F.col("t.prev").alias("parent"), "t.n_bytes"))

    def shift(x: tuple, _: dict) -> tuple:
        conv_id, length, pos, prev, fp, n_bytes, h, head_n, head, own_head = x
        gap = (_int(head) - _int(own_head)) % _P
        if gap:
            prev, fp = _raw(_join(gap, _int(prev), pos - 1 - h)), _raw(_join(gap, _int(fp), pos - h))
        return conv_id, length, pos - h + head_n, fp, prev, n_bytes
    head = F.when(F.col("head_n") > 0, F.element_at("heads", -1)["fp"])
    own = _map(turns.where(F.col("pos") > F.col("h")).drop("h")
               .join(convs.select("conv_id", "length", "h", "head_n", head.alias("head"), "own_head"), "conv_id")
               .select("conv_id", "length", "pos", "prev", "fp", "n_bytes", "h", "head_n", "head", "own_head"),
               "conv_id long, length long, depth long, key binary, parent binary, n_bytes long", shift)
    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"),
                        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"))
    return root.unionByName(taken).unionByName(own)


# -------------------------------------------------------- time-forward passes
class SpillingQueue:
    """A priority queue of tuples that keeps at most ``limit`` in memory: the
    rest lies in sorted runs of files that only this task sees and that vanish with it."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            self.heap.sort()
            for i in range(0, len(self.heap), 1024):
                pickle.dump(self.heap[i:i + 1024], file, pickle.HIGHEST_PROTOCOL)
            file.seek(0)
            self.spilled += len(self.heap)
            self.heap = []
            self._next(self._run(file))

    @staticmethod
    def _run(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        for item in run:
            heapq.heappush(self.runs, (item, id(run), run))
            return

    def least(self) -> tuple | None:
        tops = self.heap[:1] + [r[0] for r in self.runs[:1]]
        return min(tops) if tops else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


#: columns of a node that the passes read; ``top``: its parent is outside the shard
_NODE = ("shard", "level", "key", "parent_level", "parent_key", "top", "children", "leaves", "saved")


def time_forward(nodes: DataFrame, one: bool = False, queue: int = QUEUE) -> DataFrame:
    """Totals of every node over its subtree inside its shard.

    ``children``, ``leaves`` and ``saved`` hold a node's own part and what comes in from
    outside the shard; they come back with the totals of the children added.
    A parent's level is less than its child's.  ``one``: a single partition.
    """
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, messages = None, SpillingQueue(queue)
        for batch in batches:
            out = []
            for own, level, key, up, parent, top, n, leaves, saved in zip(*(batch.column(c).to_pylist() for c in _NODE)):
                if own != shard:
                    shard, messages = own, SpillingQueue(queue)
                while (m := messages.least()) and m[:2] == (-level, key):
                    messages.pop()
                    n, leaves, saved = n + 1, leaves + m[2], saved + m[3]
                out.append((n, leaves, saved))
                if not top:
                    messages.push((-up, parent, leaves, saved))
            names = batch.schema.names
            columns = dict(zip(names, batch.columns)) | {
                c: pa.array(x, pa.int64()) for c, x in zip(_NODE[-3:], zip(*out) if out else [[]] * 3)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
    order = ("shard", F.col("level").desc(), "key")
    dealt = nodes.coalesce(1) if one else nodes.repartition("shard")
    return dealt.sortWithinPartitions(*order).mapInArrow(forward, nodes.schema)


def _arrivals(tops: DataFrame) -> DataFrame:
    """What shard roots send: (level, key) of their parents and the sums."""
    return (tops.where("parent_key IS NOT NULL").groupBy(F.col("parent_level").alias("level"), F.col("parent_key").alias("key"))
            .agg(F.count(F.lit(1)).alias("more_children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))


def _received(nodes: DataFrame, arrivals: DataFrame) -> DataFrame:
    with_them = nodes.join(arrivals, ["level", "key"], "left")
    return with_them.select(*(
        (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) if c in _NODE[-3:] else F.col(c) for c in nodes.columns))


def _above(heavy: DataFrame, sent: DataFrame, shard: int, queue: int) -> DataFrame:
    """Totals of the nodes above the shards, given what the shard roots sent."""
    path = F.struct("conv_id", F.floor(F.col("depth") / shard).alias("piece"))
    top = ((F.col("depth") % shard == 0) | (F.col("parent_conv_id") != F.col("conv_id")))
    own = land(_received(heavy.withColumn("shard", path).withColumn("top", top), sent), "trie-paths")
    alone = land(time_forward(own, queue=queue).where("top"), "path-roots")
    # a path ends in one root; its parent lies on the path of the parent's least member
    above = F.when(F.col("parent_key").isNotNull(), F.struct(F.col("parent_conv_id").alias("conv_id"),
                                                             F.floor((F.col("depth") - 1) / shard).alias("piece")))
    place = lambda c: F.sha2(F.concat_ws(":", f"{c}.conv_id", f"{c}.piece"), 256)
    paths = alone.withColumn("above", above).select("level", place("shard").alias("key"), "above", "children", "leaves", "saved",
                                                    F.col("key").alias("own_key"), F.col("parent_key").alias("under"))
    levels = alone.select(F.col("shard").alias("above"), F.col("level").alias("parent_level"))
    tree = time_forward(
        paths.join(levels, "above", "left")
        .select(F.lit(0).alias("shard"), "level", "key", "parent_level", F.when(F.col("above").isNotNull(), place("above")).alias("parent_key"),
                F.col("above").isNull().alias("top"), "children", "leaves", "saved", "own_key", "under"), one=True, queue=queue)
    totals = tree.select((F.col("level") - 1).alias("parent_level"), F.col("under").alias("parent_key"), "leaves", "saved")
    return time_forward(_received(own, _arrivals(totals)), queue=queue)


def _digests(rows: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256): SHA-256 of the ids of the conversations that
    end at a node, ascending, comma-joined."""
    chunks = (rows.where("depth = length")
              .groupBy("depth", "key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []

        def ended() -> pa.RecordBatch:
            table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.string()))],
                                               ["depth", "key", "ends_sha256"])
            out.clear()
            return table
        for batch in batches:
            for depth, key, ids in zip(*(batch.column(c) for c in ("depth", "key", "ids"))):
                node = depth.as_py(), key.as_py()
                if node == at:
                    sha.update(b",")
                else:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256()
                sha.update(ids.as_buffer())
            yield ended()
        if at:
            out.append((*at, sha.hexdigest()))
        yield ended()
    return (chunks.repartition("depth", "key").sortWithinPartitions("depth", "key", "chunk").select("depth", "key", "ids")
            .mapInArrow(digest, "depth long, key binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, shard: int = SHARD, queue: int = QUEUE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows = land(rebuild(conversations), "trie-rows")
    bare = land(rows.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("parent").alias("parent_key"),
        F.max("n_bytes").alias("n_bytes"), F.max("length").alias("longest"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight")), "trie-nodes")
    up = bare.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = land(bare.join(up, ["depth", "parent_key"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "weight", F.col("depth").alias("level"), "key",
        (F.col("depth") - 1).alias("parent_level"), "parent_key", F.lit(0).cast("long").alias("children"),
        (F.col("longest") == F.col("depth")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "trie-nodes")
    heavy = nodes.where(F.col("weight") > shard)
    # weights fall along a path, so a conversation's shard root follows its last heavy node
    last = (rows.join(heavy.select("depth", "key"), ["depth", "key"], "left_semi")
            .groupBy("conv_id").agg((F.max("depth") + 1).alias("root_depth")))
    shard_roots = (rows.select("conv_id", "depth", "key").join(last, "conv_id", "left")
                   .where(F.col("depth") == F.coalesce("root_depth", F.lit(0)))
                   .select("conv_id", F.col("key").alias("shard"), F.col("depth").alias("root_depth")))
    light = nodes.where(F.col("weight") <= shard).join(shard_roots, "conv_id").withColumn("top", F.col("depth") == F.col("root_depth"))
    below = land(time_forward(light.drop("root_depth"), queue=queue), "trie-shards")
    above = _above(heavy, _arrivals(below.where("top")), shard, queue)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "key", "children", "leaves", "saved"]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (below.select(columns).union(above.select(columns)).join(_digests(rows), ["depth", "key"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: CRC-32 of a string of digits, bit by bit
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, 3988292384 * (x % 2)))))"""
ORACLE = f"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
                        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT *, {_CRC} % 9 AS h FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS s
          FROM headed a LEFT JOIN own b ON b.c = a.c - a.c % 5),
steps AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM built),
nodes AS (SELECT d, s[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, max(n) AS longest,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
                 (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(s[d]).t) END AS own_saved
          FROM steps GROUP BY d, s[1:d]),
ups AS (SELECT d AS own_d, conv_id, longest = d AS leaf, own_saved, unnest(range(0, d + 1)) AS d, p FROM nodes),
sums AS (SELECT d, p[1:d] AS p, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved_tokens,
                sum(CASE WHEN own_d = d + 1 THEN 1 ELSE 0 END) AS n_children FROM ups GROUP BY d, p[1:d])
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(s.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p
LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
"""
