"""Mixing sources to target weights (operator 5): Sainte-Lague apportionment.

Targets come from the weights, capped and reshared.  The mix is made of blocks
of equal tokens: Sainte-Lague's highest quotients give each source a whole
number of blocks, and again give each shard of a source its quota.  Within a
(source, shard) group the documents stand in seeded order, repeated as often as
needed, and the quota is the first blocks of that stream.  A shard holds a hash
slice of the documents, so a source with a third of all rows is spread over
all shards.

Defined cases: null text has size 0 and is never taken; null ``source`` is a
source of its own, last in order; repeated rows are placed one after another;
sources without words have target 0; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reqlens.llm.common import land, read_table, word_count

BLOCK_WORDS = 64
SEED = 17
MAX_REPEATS = 3
#: documents per shard aimed at, and the least number of shards
SHARD_DOCS, MIN_SHARDS = 1 << 20, 64


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients v/(2s+1), at most ``most[i]`` each; ties go
    to the earlier entry."""
    most = most or [seats] * len(votes)
    total = sum(votes)
    seats = min(seats, sum(m for m, v in zip(most, votes) if v > 0))
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    # quotients v/(s + 1/2) above 2 * total / (2 * seats - parties) are fewer than the seats, so all of them win, however
    # large or small a party is; the rest is handed out one by one
    votes = [Fraction(v) for v in votes]
    total, left = sum(votes), 2 * seats - sum(v > 0 for v in votes)
    got = [min(m, max(0, ceil((v * left - total) / (2 * total)))) if v > 0 and left > 0 else 0 for v, m in zip(votes, most)]
    heap = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, got, most)) if v > 0 and s < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def capped_targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; what a
    capped source leaves is reshared among the others by weight."""
    total = float(sum(sizes))
    target = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if weights[i] > 0]
    left = total
    while free and left > 0:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left = total - sum(target)
        free = [i for i in free if i not in set(over)]
    return target


def mix(docs: DataFrame, weights=None, block: int = BLOCK_WORDS, seed: int = SEED,
        text: str = "text") -> DataFrame:
    """``docs`` plus size, source_size, target and taken.

    ``weights`` maps the ordered list of sources to their weights; by default
    1, 2, 3, repeating.  Only one row per source and one per (source, shard)
    reach the driver."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    sized = docs.select(*own, word_count(F.col(text)).alias("size"))
    # the seeded order needs ids, sizes and sources only
    keys = land(sized.select("doc_id", "source", "size"), "mix-keys")
    n = keys.count()
    shards = max(MIN_SHARDS, -(-n // SHARD_DOCS))
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shard = F.pmod(F.xxhash64(order, F.lit("shard")), F.lit(shards)).cast("int")
    cells = (keys.withColumn("__shard", shard).groupBy("source", "__shard").agg(F.sum("size").alias("words")).collect())
    names = sorted({c["source"] for c in cells}, key=lambda s: (s is None, s or ""))
    weigh = weights(names) if weights else [1 + i % 3 for i in range(len(names))]
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for c in cells:
        sizes[at[c["source"]]] += c["words"]
    targets = capped_targets(sizes, weigh)
    blocks = sainte_lague(targets, round(sum(targets) / block))
    by_source: dict[int, list] = {}
    for c in sorted(cells, key=lambda c: c["__shard"]):
        by_source.setdefault(at[c["source"]], []).append(c)
    quota = []
    for i, own_cells in by_source.items():
        words = [c["words"] for c in own_cells]
        most = [-(-MAX_REPEATS * x // block) for x in words]
        for c, q in zip(own_cells, sainte_lague(words, blocks[i], most)):
            take = min(q * block, MAX_REPEATS * c["words"])
            rounds, rest = divmod(take, c["words"]) if c["words"] else (0, 0)
            quota.append((c["source"], c["__shard"], sizes[i], targets[i], rounds, rest))
    plan = spark.createDataFrame(
        quota, "__source string, __q_shard int, source_size long, target double, __rounds long, __rest long")
    stream = W.partitionBy("source", "__shard").orderBy("__order", "doc_id", F.xxhash64(text), "size")
    before = F.coalesce(F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (sized.withColumn("__order", order).withColumn("__shard", shard).withColumn("__before", before))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__q_shard")), "left")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before")))
    return joined.withColumn("taken", (F.col("size") * F.col("__rounds") + extra).cast("long")) \
        .select(*own, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents: each row as many times as the mix takes it, a
    partly taken last round counting when it covers at least half the text."""
    own = docs.columns
    times = F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.col("size")).cast("int")
    m = mix(docs.select(*own), **kw).where("taken > 0").withColumn("__times", times).where("__times > 0")
    return m.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    keys = docs.select("doc_id", "source", "text")
    return mix(keys).select("doc_id", "size", "source_size", "target", "taken")
