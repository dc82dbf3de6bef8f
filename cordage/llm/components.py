"""Connected components of a graph of long ids, by star contraction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordage.llm.common import staged


def _outward(both: DataFrame, least: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    return both.filter("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _inward(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them. ``edges`` (u > v) are read twice, so they should be staged."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u")
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v")
    return moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the least of its component; files, that need no staging again.

    ``edges`` (u, v), in either direction, repeats allowed. Each round is written to the shared
    folder; rounds grow with the logarithm of the longest chain. The driver sees no rows.
    """
    now = staged(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged before it is joined back: a join of two plain exchanges is one whose hot nodes Spark can split.
        inner = (F.min("v") < F.col("u")) & (F.min("v") != F.max("v"))
        least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), inner.alias("inner")), "least")
        # Where a node with a smaller neighbour has no other one, all are stars about their least nodes.
        if least.filter("inner").isEmpty():
            return least.filter("m < u").select(F.col("u").alias("node"), F.col("m").alias("root"))
        now = staged(_inward(staged(_outward(both, least), "outward")), "edges")
