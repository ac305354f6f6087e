"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before its shuffle), written, and a join of the links with it: both sides of
that join are plain exchanges, so adaptive execution can split a node with very many links over tasks. Every round is
written to the shared folder and the tables before it are deleted. Links shrink to a star around each component's
smallest node in a number of rounds that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import delete, written_at


def _large(edges: DataFrame) -> tuple[DataFrame, str]:
    """Each node's larger neighbours are linked to its smallest neighbour, or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = written_at(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), path


def _small(edges: DataFrame) -> tuple[DataFrame, str]:
    """Each node and its smaller neighbours are linked to the smallest of them. edges: u > v."""
    least, path = written_at(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    across = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), path


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link; links to itself, repeats and links without one
    of their ends don't matter."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    spark, seen = links.sparkSession, None
    edges, path = written_at(edges, "links")
    for _ in range(most_rounds):
        mark = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.max("u"), F.lit(0))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        large, least = _large(edges)
        middle, middle_path = written_at(large, "links")
        delete(spark, path, least)
        small, least = _small(middle)
        edges, path = written_at(small, "links")
        delete(spark, middle_path, least)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
