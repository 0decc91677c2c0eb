"""Connected components of a graph given as a table of links, by large and small stars.

Each round moves every node's larger neighbours, then its smaller ones, to the smallest node it
knows, so chains shorten by a factor and rounds grow with the logarithm of the longest chain.
Nodes are never gathered: a round is an aggregate, written, and a join with it, which Spark can
split at a node with very many links. Each round is written, so a lost executor costs one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.workspace import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("n"), F.least("u", "least").alias("least"))
    least = written(least, "least")
    return both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links go from the larger to the smaller node."""
    least = written(links.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("n"), "least"), "least")
    moved = links.join(least, F.col("u") == F.col("n")).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select(F.col("n").alias("u"), F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: two columns of one type, in any order and number. Returns node, component (its smallest
    node) for every linked node but the smallest ones themselves."""
    a, b = links.columns
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links, before = written(links, "links"), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        links = written(_small_star(written(_large_star(links), "links")), "links")
