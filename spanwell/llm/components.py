"""Connected components by alternating large-star and small-star rounds.

Every round writes its edges to the shared folder, so lineage stays short and a
lost executor costs one round at most.  No neighbour list is ever gathered: a
round is a minimum per node and a join back to the edges.  Rounds end when all
edges form stars, which one count per node tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    sym = _both_ways(e)
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    kept = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return kept.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node with an edge can reach, from (u, v) edges in any order.

    Repeated edges and loops are allowed; null ends are left out.
    """
    e = Stored(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "cc")
    while not _stars(e.df):
        n = Stored(_small_star(_large_star(e.df)), "cc")
        e.drop()
        e = n
    # each node with its smallest
    return e.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.df.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every edge leads from a node of its own to the smallest of its component, and nowhere on."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"), (F.col("v") > F.col("u")).cast("int").alias("up"))
    ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(0).alias("up")))
    node = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"), F.max("up").alias("up"))
    return not node.where("out > 1 OR (out = 1 AND into = 1) OR up = 1").limit(1).count()
