"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b: long) -> node, component: the smallest node that is linked to it, for every node of an edge.

    Each round points every node at its smallest neighbour, follows these pointers to their ends by doubling, and contracts the
    edges; what is left is at most half the nodes, and a star is done in one round. Pointers are found by aggregation (with
    partial sums on the map side) and joins that have one row a node on one side, so a node with very many edges is spread by
    skew-join splitting. Every round is a table in the shared folder. Loops and null ends are ignored; an empty table gives none.
    """
    now = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())
    total = None
    while now.limit(1).count():
        both = now.select(F.col("a").alias("node"), F.col("b").alias("to")).union(now.select("b", "a"))
        step = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("_t"))
            longer = written(step.join(ahead, "to").select("node", F.col("_t").alias("to"), (F.col("_t") < F.col("to")).alias("_moved")))
            moved = longer.filter("_moved").limit(1).count()
            dropped(step)
            step = longer
            if not moved:
                break
        step = step.select("node", "to")
        if total is None:
            total = step
        else:  # nodes found before point on from where they are
            on = step.select(F.col("node").alias("to"), F.col("to").alias("_t"))
            total = total.join(on, "to", "left").select("node", F.coalesce("_t", "to").alias("to"))
        ends = [step.select(F.col("node").alias(x), F.col("to").alias(y)) for x, y in (("a", "_a"), ("b", "_b"))]
        left = now.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        last, now = now, written(left.filter("a < b").distinct())
        dropped(last)
    if total is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total.select("node", F.col("to").alias("component"))
