"""Connected components of a distributed edge list.

Edges and labels stay DataFrames.  Each round hooks every component onto its
least neighbour, follows the hook of that neighbour (pointer jumping) and contracts the
edges; only components that still touch another one stay in play.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import drop_landed, land


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): ``comp`` is the least
    node reachable.  Nodes without an edge do not appear."""
    pairs = (edges.where("a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    live = land(pairs, "cc-edges")
    labels = land(live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
                  .withColumn("comp", F.col("node")), "cc-labels")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hook = land(both.groupBy("a").agg(F.min("b").alias("m"))
                    .select(F.col("a").alias("c"), F.least("a", "m").alias("p")), "cc-hooks")
        up = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jumped = hook.join(up, "p").select("c", F.col("pp").alias("p"))
        to = jumped.select(F.col("c").alias("comp"), "p")
        relabelled = land(labels.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "cc-labels")
        a, b = (jumped.select(F.col("c").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        contracted = land(live.join(a, "a").join(b, "b").where("pa <> pb")
                          .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        for old in (hook, labels, live):
            drop_landed(old)
        labels, live = relabelled, contracted
    return labels
