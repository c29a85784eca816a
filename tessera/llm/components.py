"""Distributed connected components by alternating large and small stars.

Only ``groupBy().min()`` and equi-joins are used: no neighbour list is ever gathered, so a hub with
millions of edges is a partial aggregate and a join whose hot key adaptive execution can split.
Each round is written to the shared folder; the number of rounds grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges(u, v)`` → ``(node, root)``, root the smallest node of the component.

    Nodes without an edge to another node are not returned. Null ends and loops are ignored.
    """
    e = work.save(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .distinct()
    )
    seen = _state(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = work.save(small)
        state = _state(after)
        work.drop(e)
        e = after
        if state == seen:
            break
        seen = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
