"""Connected components of an edge table, by alternating large-star and small-star rounds.

Nothing but counts comes to the driver. Each round's edges are written to the
shared folder, so the lineage stays short and a lost executor costs one round at
most. A hub's edges are reduced by partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")).withColumnRenamed("u", "_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    j = down.join(_least(down), F.col("u") == F.col("_u"))
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether a round's edges, which lead from greater to smaller nodes, are stars: each node leads to one other at most, and none that is led to leads on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return node.where("up > 1 or (up = 1 and n > 1)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: u, v longs. One row (node, label) for each node that has an edge; label: the smallest node reachable."""
    clean = lambda e: e.where("u <> v").distinct()
    now = scratch.save(clean(edges.select("u", "v")), f"{name}0")
    i = 0
    while i == 0 or not _settled(now):  # on n nodes it takes at most some log(n) ** 2 rounds
        i += 1
        now = scratch.save(clean(_small_star(clean(_large_star(now)))), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    # every edge now leads from a node to its component's smallest
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
