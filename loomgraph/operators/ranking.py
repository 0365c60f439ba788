"""First rows of groups, and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "_place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark prunes groups before it shuffles them (WindowGroupLimit)."""
    return numbered(df, by, order).filter(F.col("_place") <= n).drop("_place")


def keep_least(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The rows of each group that hold its least value."""
    return df.withColumn("_least", F.min(value).over(Window.partitionBy(*by))).filter(F.col(value) == F.col("_least")).drop("_least")


def fuse(legs: Sequence[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of legs (query_id, id, place), place from 1: (query_id, id, score)."""
    parts = [leg.select("query_id", "id", (F.lit(w) / (k + F.col("place"))).alias("part")) for leg, w in legs]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
