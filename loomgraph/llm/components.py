"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
    return r["n"], r["h"]


def components(edges: DataFrame, label: str) -> DataFrame:
    """(u, root) for every id of edges (u, v) but the roots, where root is the smallest id reachable.

    Each step is written to the shared folder, so the plan stays short and a lost executor loses one step at most. A
    step's rows never exceed its input's. A hub's edges stay one row each and are not dealt out by the hub: hubs' least
    neighbours, whose number is bounded, are broadcast to them.
    """
    spark = edges.sparkSession
    now = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, turn = common.settled(now, common.scratch(spark, f"{label}-0")), None, 0
    while (state := _state(now)) != before and state[0]:
        before, turn = state, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = common.hot_keys(near, "u", 2 * state[0])
        large = common.join_hot(both.filter(F.col("v") > F.col("u")), near.select("u", F.least("u", "m").alias("m")), hot, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = common.settled(large, common.scratch(spark, f"{label}-{turn}-large"))
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = common.hot_keys(near, "u", state[0])
        least = near.select("u", "m")
        small = common.join_hot(large, least, hot, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = common.settled(small, common.scratch(spark, f"{label}-{turn}"))
    return now.groupBy("u").agg(F.min("v").alias("root"))
