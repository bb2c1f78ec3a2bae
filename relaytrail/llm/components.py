"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaytrail.llm.common import durable_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node of ``edges`` (u, v): the least node it is connected to.

    Every step is a grouped minimum (combined before its shuffle) and a join that adaptive execution
    splits where a node has very many edges. Steps end when they no longer change the edges; what a
    step leaves is written to the shared folder.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = durable_table(edges.filter("u <> v").select(u, v).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        edges = durable_table(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
