"""Connected components of an edge table, by alternating large and small stars.

After Kiveris et al. (2014).  Every step is a minimum per node (combined before
the shuffle) and a join, so no node's neighbours meet in one task's memory.
Each round is written to the shared folder; the loop ends when a round changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import discard, staged


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join deals both sides anew and the rows of a hub can be split.
    low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "edges-low")
    out = staged(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges-large")
    discard(low)
    return out


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: node, root for every node that has an edge and is not a root itself."""
    e = staged(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == mark or not now[0]:
            return e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        mark = now
        large = _large(e)
        after = staged(_small(large), "edges")
        discard(e, large)
        e = after
