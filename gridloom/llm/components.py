"""Connected components by alternating large and small stars, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or, with its own, smaller) neighbours move to the smallest it knows."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m"))
    moved = near.join(low, "u")
    if large:
        out = moved.where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
    else:
        out = moved.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it is linked with) for every node of the edges (a, b); loops don't count.

    Ends when every edge leads from a node to its component's smallest, after about log(nodes) rounds. Each round writes
    its edges, so a lost executor costs no earlier round. No edges: an empty table."""
    edges = written(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        more = written(_star(_star(edges, True), False))
        discard(edges)
        edges = more
        # done when no node is both a centre and a leaf, and no leaf has two centres
        inner = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_semi")
        twice = edges.groupBy("b").count().where("count > 1").select(F.col("b").alias("a"))
        if inner.unionByName(twice).isEmpty():
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
