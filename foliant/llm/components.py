"""Connected components of a link table by alternating star contractions (large star, small star).

Every round is two shuffles of the links that are left; nothing is collected. A node's minimum is
found with map-side combine; its links then meet that one row in a join, so a node with very many
links puts them into one task unless adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones) to its least neighbour."""
    if large:
        around = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("v"))
    least = around.groupBy("n").agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    moved = around.join(least, "n")
    if large:
        moved = moved.where(F.col("v") > F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    moved = moved.where("a <> b")
    return moved if large else moved.distinct()  # the second half of a round drops what is double


def components(links: DataFrame) -> DataFrame:
    """Of links (a long, b long): every linked node with the least node it reaches.

    Returns node, component; a component's least node included. No links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    settled = edges.isEmpty()
    while not settled:
        fresh = written(_star(_star(edges, True), False), "links")
        drop_written(edges)
        edges = fresh
        # Settled when all links lead straight to the least node: no node has two or is one's end too.
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
        settled = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out > 0 AND into > 0)").isEmpty()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
