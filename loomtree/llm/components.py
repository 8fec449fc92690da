"""Connected components of a link table by large-star and small-star steps; links stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.llm.common import dropped, written


def _largest(edges: DataFrame) -> DataFrame:
    """Large-star: each larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v"), F.col("m").alias("u")).where("u < v").distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    """Small-star: a node and its smaller neighbours are linked to the smallest of them. Here u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    out = edges.join(least, "v")
    kept = out.select("v", F.col("m").alias("u")).unionByName(out.select(F.col("u").alias("v"), F.col("m").alias("u")))
    return kept.where("u < v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node of its component. Each round is written."""
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    edges, state = written(edges, "links"), None
    while True:
        done = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if done == state or not done[0]:
            break
        state = done
        step = written(_smallest(_largest(edges)), "links")
        dropped(spark, edges)
        edges = step
    found = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return found.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
