"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (a, b) touches; equal roots are connected.

    Each round every node moves to its smallest neighbour, and links are rewritten between the places moved to.
    Ids should be hashes: then a constant share of the nodes vanishes each round. A node with very many
    links is only aggregated or on the split side of a join.
    """
    edges = links.select("a", "b").filter("a <> b").distinct()
    found = None
    while True:
        edges = materialize(edges, "edges")
        both = edges.union(edges.select("b", "a"))
        moved = both.groupBy("a").agg(F.min("b").alias("_near"))
        moved = moved.select(F.col("a").alias("node"), F.least("a", "_near").alias("root"))
        moved = materialize(moved, "moved")
        if found is None:
            found = moved
        else:
            later = moved.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            found = found.join(later, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
            found = materialize(found, "roots")
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = (
            edges.join(left, "a")
            .join(right, "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        if edges.isEmpty():
            return found
