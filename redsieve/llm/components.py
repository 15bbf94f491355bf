"""Connected components by alternating large-star and small-star rounds.

Every round is two joins against per-node minima, so no task and no driver ever
holds the neighbours of a node. Rounds grow with the logarithm of the number of
nodes. Where all edges are few (FEW_EDGES), a round is one task without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import forget, settle, tally


#: From so many edges on, minima are written before they are joined: then both sides of the join come from a shuffle of its
#: own, and AQE can split the partition of a node with very many edges.
MANY_EDGES = 2_000_000
#: Up to so many edges (16 bytes each) lie in one partition, as some seven shuffles of next to nothing cost more than their rows.
FEW_EDGES = 200_000


def _joined(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return edges.join(settle(least, "least") if many else least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node reachable.

    Nulls, loops and repeated edges in the input are ignored; without edges the
    result is empty.
    """
    now = settle(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = tally(now, "u", "v")
    while before[0]:
        many = before[0] >= MANY_EDGES
        laid = (lambda df: df.coalesce(1)) if before[0] <= FEW_EDGES else (lambda df: df)
        both = laid(now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            _joined(both.where("v > u"), least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, least, many).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = settle(laid(small.unionAll(least.select("u", F.col("m").alias("v")))).distinct(), "edges")
        seen = tally(after, "u", "v")
        forget(now)
        now = after
        if seen == before:
            break
        before = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
