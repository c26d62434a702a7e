"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscript.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component), component being the smallest node reachable, for every node of a link.

    Each round, every node points at its least neighbour or itself, pointers are shortened until they reach a root, and the
    links are moved to the roots; links within a root go, so each round at least halves the nodes that are left. A node with
    many links costs partial minima only. What a round has found is written.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    placed = None
    while placed is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "roots")
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(roots.join(above, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root")), "roots")
            roots = jumped.select("node", "root")
            if jumped.where("root <> old").isEmpty():
                break
        if placed is None:
            placed = roots.withColumnRenamed("root", "component")
        else:
            further = placed.join(roots.withColumnRenamed("node", "component"), "component", "left")
            placed = written(further.select("node", F.coalesce("root", "component").alias("component")), "placed")
        moved = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return placed
