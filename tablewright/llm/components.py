"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import drop_stage, stage

#: Edges per task. A round over few edges then needs few tasks and, with one, no shuffle.
EDGES_PER_TASK = 200_000


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("least"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
        least.select("u", F.col("least").alias("v"))
    )


def _open(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that keep them from being stars around their smallest node."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(True).alias("out"), F.lit(False).alias("in")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(False).alias("out"), F.lit(True).alias("in"))
    )
    nodes = ends.groupBy("node").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.max("out").alias("out"), F.max("in").alias("in"), F.count("v").alias("edges")
    )
    wrong = F.col("out") & (F.col("in") | (F.col("low") != F.col("high")))
    row = nodes.agg(F.sum("edges"), F.count_if(wrong)).first()
    return row[0] or 0, row[1] or 0


def _sized(edges: DataFrame, count: int) -> DataFrame:
    return edges.coalesce(max(1, -(-count // EDGES_PER_TASK)))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node that links reach, for every node of an edge.

    Edges are (u, v) in any direction; loops and repeats do no harm. A few rounds suffice, logarithmic
    in the length of the longest chain. Minima are taken map-side, so a node with very many links
    sends one row per task; each round is a written table, of which the former is deleted.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links = stage(links, "components")
    count, wrong = _open(links)
    while wrong:
        before = _sized(links, count)
        after = stage(_sized(_small(_large(before)).filter("u <> v").distinct(), count), "components")
        drop_stage(spark, links)
        links = after
        count, wrong = _open(_sized(links, count))
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
