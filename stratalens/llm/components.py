"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _contract(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One step over edges (a, b), a > b. Each node's least neighbour m becomes the neighbour of its others.

    larger_only: of those above the node (large star), else of those below it (small star). Nothing is collected by node:
    the least neighbour comes from an aggregation that combines before the shuffle, and is joined back to the edges.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        out = both.join(least, both["a"] == least["n"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = edges.join(least, edges["a"] == least["n"])
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("n").alias("x"), F.col("m").alias("y")))
    return out.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of longs -> (node, component): the least node that links reach, for each node of a link between two nodes.

    Each round is written to the shared folder, so lineage stays short. The number of rounds grows with the logarithm of
    the longest chain; it ends when a round changes nothing.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(most_rounds):
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before, last = mark, edges
        edges = materialize(_contract(_contract(edges, True), False), "stars")
        release(last)
    else:
        raise RuntimeError("components did not settle")
    top = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return top.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
