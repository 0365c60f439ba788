"""What a walk reached, in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import BUCKETS, confidence, confidence_bucket


def rows(reached: DataFrame) -> Column:
    """How many rows reached has, or stands for where it is a tally with their number n."""
    return F.sum("n") if "n" in reached.columns else F.count("*")


def hops(reached: DataFrame) -> DataFrame:
    """(seed, depth, hops)."""
    return reached.groupBy("seed", "depth").agg(rows(reached).alias("hops"))


def archetypes(reached: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(seed, archetype, n); tagged (id, archetype), if reached has no archetypes itself."""
    reached = reached if tagged is None else reached.join(tagged, "id")
    return reached.groupBy("seed", "archetype").agg(rows(reached).alias("n"))


def buckets(reached: DataFrame) -> DataFrame:
    """(bucket, n) for all five buckets of confidence, empty ones too."""
    found = reached.groupBy(confidence_bucket(confidence(F.col("depth"), F.col("edge_kind"))).alias("bucket")).agg(rows(reached).alias("n"))
    return reached.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string").join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
