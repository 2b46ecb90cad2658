"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import drop_table, stage_table


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Of each node that reaches a smaller one: node and component, the smallest it reaches. All others are their own.

    Each round's links are a written table in the shared folder, so the lineage
    stays short. A node with very many links costs one pre-aggregated minimum
    and a join that Spark can split. No links give no rows; loops are ignored.
    """
    spark = links.sparkSession
    large, small = F.greatest(left, right), F.least(left, right)
    edges = stage_table(spark, links.where(F.col(left) != F.col(right)).select(large.alias("u"), small.alias("v")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage_table(spark, lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "links")
        drop_table(spark, edges)
        edges = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
