"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Staged


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours.

    The minimum is grouped by a wrapped key: the join then has an exchange of
    its own on both sides, which lets adaptive execution split the edges of a
    node that has very many.
    """
    least = (pairs.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m"))
             .select(F.col("k.u").alias("u"), F.least("k.u", "m").alias("m")))
    return pairs.join(least, "u")


def _signature(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not itself the
    least node of its component; root is that least node.

    Loops and repeated edges are allowed; no edges give an empty table. Each
    round is written to the shared checkpoint folder, and rounds grow with the logarithm of the longest
    path.
    """
    stage = Staged(edges.sparkSession)
    e = stage.put(edges.where("u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_least_neighbour(both).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        m = _least_neighbour(large)
        small = (m.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stage.put(small)
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
