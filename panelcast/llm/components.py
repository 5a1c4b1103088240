"""Connected components of a graph that no task holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _nearest(edges: DataFrame, both: bool) -> DataFrame:
    """Large star: every larger neighbour of a node goes to the node's smallest
    neighbour. Small star: the node and its smaller neighbours do."""
    if both:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = around.groupBy("a").agg(F.min("b").alias("m"))
    smallest = smallest.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    met = around.join(smallest, F.col("a") == F.col("u"))
    if both:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge (a, b) the smallest node that edges
    lead to. Self-loops and repeated edges are welcome; nulls are not.

    Large and small stars take turns until nothing changes; the number of rounds
    grows with the logarithm of the longest path. Neighbours are never gathered
    in one row; those of a node with very many, two numbers each, meet in one partition of
    the join, which Spark splits if it is much larger than others (skew join).
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    links = materialize(edges.where("a <> b").distinct())
    seen = _signature(links)
    while True:
        links = materialize(_nearest(_nearest(links, True), False))
        now = _signature(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
