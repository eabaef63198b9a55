"""Connected components of an undirected edge list by alternating stars, each round cut to a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.common import written


def _least(e: DataFrame) -> DataFrame:
    """Each node's least neighbour, written: a join with it reads two plain shuffles, of which adaptive execution can
    split the part of a node with very many edges."""
    return written(e.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    got = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return got.filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all go to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    joined = down.join(least, "u")
    got = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return got.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node that has an edge; the root is the least node of its component.

    Edges are ``(u, v)`` of integers; loops and repeats are fine. A star's edges all end in its least node, so
    the rounds end when neither operation changes anything, after about log n rounds. Only counts and sums of
    hashes reach the driver.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    if not mark[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        e = written(_small(_large(e)), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
