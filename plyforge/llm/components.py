"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.common import discard, merged_if_large, staged


#: Edges that one task handles; small graphs don't pay for more tasks than they need.
EDGES_PER_TASK = 100_000
#: Bytes of an edge or a node in a broadcast table.
EDGE_BYTES = 60


def connected_components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    Edges may repeat and point either way; loops are ignored. Each round joins every edge to
    the smallest neighbour of one of its ends, an aggregate, so no neighbour list is ever
    gathered. Rounds end when an edge table equals the one before it; each is written to the
    shared folder and the one before it deleted.
    """
    spark = edges.sparkSession
    stars = staged(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name
    )
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state or state[0] == 0:
            return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        before = state
        tasks = -(-state[0] // EDGES_PER_TASK)
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(merged_if_large(least, 2 * state[0], EDGE_BYTES), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        parent = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = (
            large.join(merged_if_large(parent, 2 * state[0], EDGE_BYTES), "u")
            .select(F.explode(F.array(F.struct("m", F.col("v").alias("b")), F.struct("m", F.col("u").alias("b")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.b").alias("b"))
            .where("a != b")
            .distinct()
            .coalesce(tasks)
        )
        old, stars = stars, staged(small, name)
        discard(spark, old)
