"""Lines and outlines of files, and matches of patterns in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import first, numbered


def lines(files: DataFrame, content: Column, *by: str) -> DataFrame:
    """(*by, line_no, line), from line 1."""
    rows = files.select(*by, F.posexplode(F.split(content, "\n")).alias("at", "line"))
    return rows.select(*by, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def shown(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """rows of lines() from line start to end, with shown, the line behind its number."""
    rows = rows.filter(F.col("line_no") >= max(1, start or 1))
    rows = rows if end is None else rows.filter(F.col("line_no") <= end)
    return rows.withColumn("shown", F.concat(F.col("line_no").cast("string"), F.lit(": "), "line")).drop("line")


def matches(rows: DataFrame, pattern: str, by: list[str], context: int = 2) -> DataFrame:
    """Lines of lines() that match, with the lines before and after them as arrays.

    Matches are found first; only their neighbours are joined to them, by file and line.
    """
    hit = rows.filter(F.col("line").rlike(pattern))
    if not context:
        return hit.withColumns({"before": F.array().cast("array<string>"), "after": F.array().cast("array<string>")})
    wanted = hit.select(*by, F.col("line_no").alias("match"), F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no")).filter("line_no != match and line_no > 0")
    near = wanted.join(rows, [*by, "line_no"]).groupBy(*by, "match").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("near"))  # 2 * context lines at most
    near = near.withColumnRenamed("match", "line_no")
    side = lambda keep: F.coalesce(F.transform(F.filter("near", keep), lambda x: x["line"]), F.array().cast("array<string>"))
    return hit.join(near, [*by, "line_no"], "left").withColumns({"before": side(lambda x: x["line_no"] < F.col("line_no")), "after": side(lambda x: x["line_no"] > F.col("line_no"))}).drop("near")


def match_counts(rows: DataFrame, pattern: str, by: str, file: str) -> DataFrame:
    """(by, matches, files): how many lines of how many files match."""
    return rows.filter(F.col("line").rlike(pattern)).groupBy(by).agg(F.count("*").alias("matches"), F.countDistinct(file).alias("files"))


def limited(rows: DataFrame, by: list[str], total: int, per_file: int) -> DataFrame:
    """The first total matches in order, per_file of a file at most; truncated says that there are more."""
    kept = first(rows.withColumn("_all", F.lit(1)), by, [F.col("line_no")], per_file).drop("_all")
    few = kept.orderBy(*by, "line_no").limit(total + 1)
    place = F.row_number().over(Window.orderBy(*by, "line_no"))  # total + 1 rows
    few = few.withColumns({"_place": place, "truncated": F.count("*").over(Window.partitionBy(F.lit(1))) > total})
    return few.filter(F.col("_place") <= total).drop("_place")


def outline(symbols: DataFrame, by: list[str], max_depth: int = 2) -> DataFrame:
    """symbols (id, parent_id, start_line, ...) of files with depth (1: top) and place, as a reader meets them; deeper ones are left out."""
    top = symbols.filter("parent_id is null").withColumns({"depth": F.lit(1), "_path": F.array(F.struct("start_line", "id"))})
    out = level = top
    for depth in range(2, max_depth + 1):
        above = level.select(*by, F.col("id").alias("parent_id"), "_path")
        level = symbols.join(above, [*by, "parent_id"]).withColumns({"depth": F.lit(depth), "_path": F.concat("_path", F.array(F.struct("start_line", "id")))}).select(out.columns)
        out = out.unionByName(level)
    return numbered(out, by, [F.col("_path")], "place").drop("_path")
