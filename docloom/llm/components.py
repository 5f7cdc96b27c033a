"""Connected components of a link relation, by contraction.

Every node points to its least neighbour, pointers are doubled until they
stand, and the links are relabelled; a round at least halves every component's
nodes.  Nothing reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): ``root`` is the least node reachable.
    Nodes without links are not listed; loops and repeats are harmless."""
    edges = cut(links.select("a", "b").filter("a <> b").distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        up = cut(up)
        while True:
            on = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = cut(up.join(on, "p").select("v", F.col("q").alias("p"), F.expr("q <> p").alias("moved")))
            moved = not nxt.filter("moved").isEmpty()
            up = nxt.select("v", "p")
            if not moved:
                break
        if labels is None:
            labels = up.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(up.select(F.col("v").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = cut(labels)
        a, b = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct())
        if edges.isEmpty():
            return labels
