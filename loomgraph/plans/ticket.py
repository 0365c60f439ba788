"""Ticket analysis: what depends on each symbol that a ticket's search finds, for all tickets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import confidence
from ..operators.graph import impact, neighbours
from ..operators.ranking import first, numbered
from ..session import cut

#: Neighbours of a kind, affected symbols and affected tests that are listed for each symbol.
CAP = 25
#: Fixed names of the neighbours' lists, by direction and kind of edge.
BUCKETS = {("in", "calls"): "callers", ("out", "calls"): "callees", ("out", "extends"): "extends", ("out", "implements"): "implements", ("in", "extends"): "extended_by", ("in", "implements"): "implemented_by"}


def analyze(found: DataFrame, symbols: DataFrame, edges: DataFrame, ancestors: DataFrame, max_depth: int = 2, reached: DataFrame | None = None) -> DataFrame:
    """found (query_id, id) with the numbers of affected symbols, direct ones and incoming edges.

    A symbol that several tickets find is walked from once.
    """
    found = found if reached is not None else cut(found.select("query_id", "id"))
    reached = impact(found.select(F.col("id").alias("seed")).distinct(), edges, symbols, ancestors, max_depth) if reached is None else reached
    counts = reached.groupBy("seed").agg(F.count("*").alias("affected"), F.count(F.when(F.col("depth") == 1, 1)).alias("direct"))
    incoming = edges.groupBy(F.col("target_id").alias("_target")).agg(F.count("*").alias("incoming"))
    rows = found.join(counts.withColumnRenamed("seed", "_seed"), F.col("id") == F.col("_seed"), "left").join(incoming, F.col("id") == F.col("_target"), "left")
    zero = F.lit(0).cast("long")
    return rows.select("query_id", "id", *[F.coalesce(c, zero).alias(c) for c in ("affected", "direct", "incoming")])


def context(ids: DataFrame, edges: DataFrame, reached: DataFrame, cap: int = CAP) -> DataFrame:
    """(id, bucket, place, other, total): the first cap neighbours of each kind; callers by dispatch follow direct ones.

    ids (id); reached are impact() rows with the ids as seeds. total counts a bucket's neighbours before the cut.
    """
    near = neighbours(edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").unionByName(edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")))
    near = near.join(ids, "id", "left_semi").withColumn("late", F.lit(0))
    later = reached.filter("depth = 1 and via_id is not null").select(F.col("seed").alias("id"), F.lit("in").alias("direction"), F.lit("calls").alias("kind"), F.col("id").alias("other")).distinct()
    rows = near.unionByName(later.join(near.drop("late"), ["id", "direction", "kind", "other"], "left_anti").withColumn("late", F.lit(1)))
    bucket = F.lit(None).cast("string")
    for (direction, kind), name in BUCKETS.items():
        bucket = F.when((F.col("direction") == direction) & (F.col("kind") == kind), name).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket).filter("bucket is not null")
    totals = rows.groupBy("id", "bucket").agg(F.count("*").alias("total"))
    order = [F.col("late"), F.col("other")]
    return first(numbered(rows, ["id", "bucket"], order, "place"), ["id", "bucket"], order, cap).join(totals, ["id", "bucket"]).select("id", "bucket", "place", "other", "total")


def by_repository(reached: DataFrame, about: DataFrame) -> DataFrame:
    """(seed, repo, affected, tests): what each symbol's walk reached, by repository; about (id, repo, archetype)."""
    return counted(reached.join(about.select("id", "repo", "archetype"), "id").withColumn("n", F.lit(1)))


def counted(tally: DataFrame) -> DataFrame:
    """(seed, repo, affected, tests) of a tally (seed, repo, archetype, n)."""
    return tally.groupBy("seed", "repo").agg(F.sum("n").alias("affected"), F.sum(F.when(F.col("archetype") == "test", F.col("n")).otherwise(0)).alias("tests"))


def listed(reached: DataFrame, about: DataFrame | None = None, tests: bool = False, cap: int = CAP) -> DataFrame:
    """(seed, place, id, depth, confidence): the first cap affected symbols, or affected tests, best first; about (id, archetype), unless
    reached has been joined with it."""
    rows = (reached if about is None else reached.join(about.select("id", "archetype"), "id")).withColumn("confidence", confidence(F.col("depth"), F.col("edge_kind")))
    rows = rows.filter("archetype = 'test'") if tests else rows
    order = [F.desc("confidence"), F.col("depth"), F.col("id")]
    return first(numbered(rows, ["seed"], order, "place"), ["seed"], order, cap).select("seed", "place", "id", "depth", "confidence")


def totals(found: DataFrame, by_repo: DataFrame, repos: DataFrame) -> DataFrame:
    """(query_id, symbols, repos, affected, tests): for each ticket, over the symbols found (query_id, id); repos (id, repo)."""
    each = by_repo.groupBy("seed").agg(F.sum("affected").alias("affected"), F.sum("tests").alias("tests"))
    rows = found.select("query_id", "id").join(repos, "id").join(each.withColumnRenamed("seed", "id"), "id", "left")
    zero = F.lit(0).cast("long")
    return rows.groupBy("query_id").agg(F.count("*").alias("symbols"), F.countDistinct("repo").alias("repos"), F.coalesce(F.sum("affected"), zero).alias("affected"), F.coalesce(F.sum("tests"), zero).alias("tests"))
