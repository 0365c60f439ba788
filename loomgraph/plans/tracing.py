"""Traces: what a query did, as small summaries that can be kept as JSON. Each is made of aggregates over the query's own tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import confidence
from ..sources.diffs import line_totals
from . import summary

#: Best results that a trace of a walk lists.
TOP = 20
SETTING = "LOOMGRAPH_TRACE"


def wanted(asked: bool | None) -> bool:
    """Whether to trace: the argument decides, and without one the environment."""
    return asked if asked is not None else os.environ.get(SETTING, "").lower() in ("1", "true", "on", "yes")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def best(reached: DataFrame, n: int = TOP) -> DataFrame:
    """The n best rows of impact()."""
    rows = reached.withColumn("confidence", confidence(F.col("depth"), F.col("edge_kind")))
    return rows.orderBy(F.desc("confidence"), "depth", "seed", "id").limit(n).select("id", "depth", "edge_kind", "resolution", "via", "confidence")


def edge_kinds(reached: DataFrame) -> DataFrame:
    """(edge_kind, affected)."""
    return reached.groupBy("edge_kind").agg(summary.rows(reached).alias("affected"))


def search_trace(query: dict, legs: DataFrame) -> dict:
    """legs (stage, query_id, id, place), as search.trace() gives them."""
    return {"tool": "search", "query": query, "stages": _rows(legs.groupBy("stage").agg(F.count("*").alias("results")).orderBy("stage"))}


def impact_trace(query: dict, reached: DataFrame) -> dict:
    hops = summary.hops(reached).groupBy("depth").agg(F.sum("hops").alias("candidates")).orderBy("depth")
    return {"tool": "impact", "query": query, "hops": _rows(hops), "confidence": _rows(summary.buckets(reached).orderBy("bucket")), "total": reached.count(), "top": _rows(best(reached))}


def pattern_trace(query: dict, counts: DataFrame, returned: int) -> dict:
    """counts (repo, matches, files), before results are cut."""
    found = _rows(counts.orderBy("repo"))
    total = sum(r["matches"] for r in found)
    return {"tool": "search_pattern", "query": query, "repos": found, "total": total, "returned": returned, "truncated": total > returned}


def change_trace(query: dict, between: tuple[str, str | None], warnings: list[str], hunks: DataFrame, changed: DataFrame, reached: DataFrame) -> dict:
    """changed (id, file_id, reason, ...); reached: impact() rows of all changed symbols."""
    by_file = changed.groupBy("file_id").agg(F.count("*").alias("symbols")).orderBy("file_id")
    expanded = reached.groupBy("seed").agg(F.count("*").alias("affected")).orderBy("seed")
    kinds = edge_kinds(reached).orderBy("edge_kind")
    return {
        "tool": "detect_changes", "query": query, "refs": {"base": between[0], "head": between[1]}, "warnings": warnings, "diff": _rows(line_totals(hunks))[0], "files": _rows(by_file), "expansion": _rows(expanded),
        "total": {"changed": changed.count(), "affected": reached.select("id").distinct().count()}, "edge_kinds": {r["edge_kind"]: r["affected"] for r in _rows(kinds)},
    }


def plain_trace(tool: str, query: dict, **numbers) -> dict:
    return {"tool": tool, "query": query, **numbers}
