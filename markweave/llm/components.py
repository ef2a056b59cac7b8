"""Connected components of an edge table, by rounds of contraction.

Each round every node picks the least neighbour (itself included) under a hashed order,
nodes are replaced by their picks, and loops and repeats go. Hashed order makes long
chains shrink by a constant share a round. Minima are pre-aggregated before the shuffle,
so the hub of a star is a few rows; the join back is one that Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markweave.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long), one root a component.

    Which node is the root is arbitrary but the same for the whole component. Loops,
    repeats and both directions of an edge are fine; no edges give no rows.
    """
    rest = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    turn = 0
    while not rest.isEmpty():
        key = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("h"), F.col(c).alias("v"))
        both = rest.select("a", key("b").alias("k")).unionByName(rest.select(F.col("b").alias("a"), key("a").alias("k")))
        best = both.groupBy("a").agg(F.min("k").alias("k"))
        pick = saved(best.select(F.col("a").alias("node"), F.least(F.col("k"), key("a"))["v"].alias("to")), "picks")
        steps.append(pick)
        left = rest.join(pick, rest["a"] == pick["node"]).select(F.col("to").alias("a"), "b")
        moved = left.join(pick, left["b"] == pick["node"]).select("a", F.col("to").alias("b"))
        rest = saved(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1].select("node", F.col("to").alias("root"))
    for pick in reversed(steps[:-1]):
        later = found.withColumnRenamed("node", "to")
        found = pick.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
