"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group minimum and a join, so a node of any degree is spread over map-side sums; the
edges of each round are written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import store

#: Edges up to which a step runs in one task.
FEW = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node."""
    now = store.write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = (row["n"], row["h"])
        near = (lambda df: df.coalesce(1)) if row["n"] <= FEW else (lambda df: df)  # a step is then one short task instead of three shuffles
        both = near(now.union(now.select("v", "u")))
        least = store.broadcast_if_small(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), 2 * row["n"], 32)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = store.broadcast_if_small(large.groupBy("u").agg(F.min("v").alias("m")), 2 * row["n"], 32)
        small = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
        now = store.write_table(near(small).distinct(), "edges")
