"""Connected components of an edge table by repeated contraction.

Each round gives every node the neighbour (or itself) that comes first in a
fixed random-looking order and merges the two; the graph of merged nodes is
what is left for the next round, so that a round at least halves the nodes
that still have edges, chains included. Edges, nodes and labels stay in written
tables. Minima are combined before the shuffle and joins are plain ones that
adaptive execution may split, so a node with very many links needs no task of
its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a long, b long); nodes share a label if and only if a path joins them."""
    both = edges.select("a", "b").where("a <> b")
    left = scratch.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    while not left.isEmpty():
        if len(maps) >= rounds:
            raise RuntimeError("contraction did not end")
        step = left.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least(F.col("m"), order("a"))["n"].alias("to"))
        step = scratch.write(step)
        maps.append(step)
        ends = left.join(step.withColumnRenamed("to", "x"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        new = scratch.write(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        scratch.drop(left)
        left = new
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    first = maps[0].select(F.col("a").alias("node"), F.col("to").alias("label"))

    def follow(labels: DataFrame, step: DataFrame) -> DataFrame:
        return labels.join(step.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))

    return reduce(follow, maps[1:], first)
