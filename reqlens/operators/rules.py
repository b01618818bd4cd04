"""Pattern-rule store (K8): merge rule tables, earliest rule per replacement wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "ord INT, pattern STRING, replacement STRING"


def merge_rules(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """K8: append ``new`` to ``existing``, drop rules with an empty
    replacement, keep the earliest rule per replacement, renumber ``ord``.

    Rule tables are small by construction (top-N outputs); the de-duplication
    is a grouping by replacement, and the renumbering window runs over the
    de-duplicated table only.
    """
    parts = []
    if existing is not None:
        parts.append(existing.select("ord", "pattern", "replacement").withColumn("__src", F.lit(0)))
    parts.append(new.select("ord", "pattern", "replacement").withColumn("__src", F.lit(1)))
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    allr = allr.filter(F.col("replacement").isNotNull() & (F.col("replacement") != ""))
    first = allr.groupBy("replacement").agg(
        F.min_by(F.struct("pattern", "__src", "ord"), F.struct("__src", "ord")).alias("r"))
    first = first.select(F.col("r.__src").alias("__src"), F.col("r.ord").alias("__ord"),
                         F.col("r.pattern").alias("pattern"), "replacement")
    w = Window.orderBy("__src", "__ord", "replacement")
    return first.select((F.row_number().over(w) - 1).cast("int").alias("ord"), "pattern", "replacement")
