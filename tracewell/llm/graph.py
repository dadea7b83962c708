"""Connected components of thin edge tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import cut

#: Edges of one partition, as thin rows of two numbers.
EDGES = 250_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the least node around it.

    Least neighbours are pre-aggregated on the map side, and the join back may
    be split by adaptive execution, so a node with very many edges is no hot spot.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.coalesce(parts)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).coalesce(parts)
    return moved.where(F.col("u") != F.col("v"))


def _settled(edges: DataFrame, parts: int) -> bool:
    """Whether each node has one edge at most, and none leads on from its end: then ends are components."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("r")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("r"))).coalesce(parts)
    return roles.groupBy("x").agg(F.sum("r").alias("out"), F.min("r").alias("r")).where("out > 1 OR (out = 1 AND r = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over (u, v) edges; only nodes with an edge appear.

    Edges are kept in partitions of at least ``EDGES`` rows each, so that a small
    table is not spread over as many tasks as the corpus.
    """
    seen = Observation()
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct().observe(seen, F.count(F.lit(1)).alias("n")))
    parts = min(now.rdd.getNumPartitions(), -(-seen.get["n"] // EDGES)) or 1
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True, parts), False, parts).distinct())
        if _settled(now, parts):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
