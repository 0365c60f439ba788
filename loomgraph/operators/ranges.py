"""Line ranges: runs, bounds and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(lines: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    """Maximal runs of consecutive distinct lines: by, start_line, end_line."""
    one = lines.select(*by, line).distinct()
    run = one.withColumn("_run", F.col(line) - F.row_number().over(Window.partitionBy(*by).orderBy(line)))
    return run.groupBy(*by, "_run").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("_run")


def bounds(lines: DataFrame, by: Sequence[str], line: str = "line") -> DataFrame:
    return lines.groupBy(*by).agg(F.min(line).alias("start_line"), F.max(line).alias("end_line"))


def hits(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether a span has a line of a range. An empty range (last = first - 1) is an insertion point: it needs both neighbours."""
    return (start <= last) & (end >= first) | (last < first) & (start <= last) & (end >= first)


#: Lines of a bin by which spans and ranges meet.
BIN = 64


def _bins(first: Column, last: Column) -> Column:
    low, high = F.least(first, last), F.greatest(first, last)
    return F.explode(F.sequence(F.floor(low / BIN).cast("int"), F.floor(high / BIN).cast("int")))


def overlap(spans: DataFrame, ranges: DataFrame, on: Sequence[str]) -> DataFrame:
    """spans (start_line, end_line) with the ranges (first, last) of the same file that hit them.

    Both are cut into bins of BIN lines and meet by bin; a pair that shares several counts in the first of these alone.
    """
    low = lambda a, b: F.floor(F.least(a, b) / BIN).cast("int")
    s = spans.withColumn("_bin", _bins(F.col("start_line"), F.col("end_line")))
    r = ranges.withColumn("_bin", _bins(F.col("first"), F.col("last")))
    both = s.join(r, [*on, "_bin"]).filter(hits(F.col("start_line"), F.col("end_line"), F.col("first"), F.col("last")))
    return both.filter(F.col("_bin") == F.greatest(low(F.col("start_line"), F.col("end_line")), low(F.col("first"), F.col("last")))).drop("_bin")
