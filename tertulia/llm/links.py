"""Groups of linked items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _ordered(e: DataFrame) -> DataFrame:
    return e.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the least node that edges (u, v) reach from each node that has an edge.

    Large-star and small-star steps in turn: hubs hand their neighbours to
    their least neighbour, so no list of neighbours is ever collected.  Stops
    when a round changes no edge; rounds grow with the logarithm of the longest
    path.
    """
    cur = materialize(_ordered(edges), "edges")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")),
                                                             F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(_ordered(small), "edges")
        if after.count() == cur.count() and after.join(cur, ["u", "v"], "left_anti").isEmpty():
            break
        cur = after
    return cur.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        cur.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
