"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours greater than a node move to the node's least
    neighbour. Small star: the node and its lesser neighbours do. Both are a
    minimum per node (combined before the shuffle) and a join back."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long) -> (node, root): every node that has a link to
    another, with the least node it is connected to. The number of rounds grows
    with the logarithm of the longest path; each is written to the shared
    folder. Nulls and self-links are dropped; no edges give no rows."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        edges = materialize(_star(_star(edges, True), False), "links")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(
        F.min("root").alias("root"))
