"""Connected components by alternating large and small stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.llm import _shared as S


def _minimum(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its partners.

    Minima are combined before the shuffle; nodes with a large part of all pairs are broadcast, so that no task gets all of one's.
    """
    least = S.checkpointed(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    return S.join_counted(pairs, least, "u", "n", total).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """From undirected (a, b) of any orderable type: (node, component), the component's least node.

    Only nodes of some edge between two different nodes are returned. Each round is written to
    the checkpoint folder; there are about as many as the logarithm of the longest path.
    """
    stars = S.checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    signature = _signature(stars)
    while signature[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(both, 2 * signature[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = S.checkpointed(large)
        small = _minimum(large, signature[0])
        joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        stars = S.checkpointed(joined.filter("u <> v").distinct())
        before, signature = signature, _signature(stars)
        if before == signature:
            break
    hubs = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)


def _signature(stars: DataFrame) -> tuple:
    """Number of edges and a sum over them; edges that stay alike keep it."""
    r = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
