"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import scope, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node, the larger or the smaller ones, move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = written(least, "least")  # so that the join below can split a node with very many links
    moved = both.join(least, "u")
    moved = moved.where("v > u") if large else moved.where("v < u").unionByName(least.select("u", F.col("u").alias("v"), "m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def components(edges: DataFrame, outlives: int = 0) -> DataFrame:
    """node and label (the least node it reaches) of every node of ``edges`` (u, v), written, by alternating stars.

    The number of rounds grows with the logarithm of the longest chain; each round's edges are written.
    """
    with scope(edges.sparkSession):
        edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        mark = _mark(edges)
        while mark[0]:
            edges = written(_star(written(_star(edges, True), "edges"), False), "edges")
            now = _mark(edges)
            if now == mark:
                break
            mark = now
        labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        return written(labels, "labels", 1 + outlives)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
