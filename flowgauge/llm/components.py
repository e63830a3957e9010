"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import keep


def pointed(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step over edges (a > b): every node's chosen neighbours point at the least node of
    its neighbourhood. `upward` takes the greater neighbours, else the smaller ones.

    A node's least neighbour comes from an aggregate that combines within map tasks; it joins back
    by equality, which adaptive execution splits at a hot node.
    """
    if upward:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = near.join(least, "a")
    if upward:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    moved = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the least node it can reach.

    Alternates the two star steps until nothing changes, which takes a number of rounds that grows
    with the logarithm of the nodes. Each round is a stored table; edges never leave the executors.
    """
    undirected = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = keep(undirected.distinct(), "edges")
    sums = None
    while True:
        large = pointed(now, upward=True).distinct()
        now = keep(pointed(large, upward=False).distinct(), "edges")
        mark = F.xxhash64("a", "b")
        found = tuple(now.agg(F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 32))).head())
        if found == sums:
            break
        sums = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
