"""Hybrid search for many queries at once: lexical, vector and name legs, rank fusion, kind boost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import kind_boost, name_score, terms
from ..operators.ranking import first, fuse, numbered
from ..session import cut

LEG, RRF_K, WEIGHTS = 30, 60, {"fts": 1.0, "semantic": 1.0, "name": 1.5}


def postings(symbols: DataFrame) -> DataFrame:
    """(id, term, tf) over name, qualified name, documentation comment and signature, as far as symbols has them."""
    cols = [F.col(c) for c in ("name", "qualified_name", "doc_comment", "signature") if c in symbols.columns]
    return symbols.select("id", F.explode(terms(*cols)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def lexical(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id, matched, tf, every): symbols with all terms of a query; with any of them, where none has all.

    One join gives both: a window over the matches tells whether a query has a full match.
    """
    q = query_terms(queries)
    wanted = q.groupBy("query_id").agg(F.count("*").alias("wanted"))
    found = q.join(index, "term").groupBy("query_id", "id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf")).join(wanted, "query_id")
    full = F.col("matched") == F.col("wanted")
    any_full = F.max(full.cast("int")).over(Window.partitionBy("query_id")) == 1
    return found.withColumn("every", any_full).filter(full | ~F.col("every")).drop("wanted")


def lexical_leg(queries: DataFrame, index: DataFrame, n: int = LEG) -> DataFrame:
    order = [F.desc("matched"), F.desc("tf"), F.col("id")]
    return first(numbered(lexical(queries, index), ["query_id"], order, "place"), ["query_id"], order, n)


#: Query vectors that are sent to all tasks at once, and vectors that a task multiplies them with at once.
QUERY_BLOCK, ROW_BLOCK = 2_048, 1_024


def _nearest(asked: pa.Table, n: int, kind: str):
    """A mapInArrow function: of each partition's vectors the n nearest to each asked vector, by blocked matrix products."""
    ids = asked.column("query_id").to_numpy()
    q = np.array(asked.column("embedding").to_pylist(), float).reshape(len(ids), -1)
    norm = np.sqrt((q * q).sum(axis=1))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # ids and similarities, n of each query at most
        for batch in parts:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                v = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = np.round(q @ v.T / (norm[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]), 9)
                own = np.broadcast_to(np.asarray(part.column(0).to_pylist(), object if kind == "string" else np.int64), near.shape)
                if held is not None:
                    own, near = np.concatenate([held[0], own], axis=1), np.concatenate([held[1], near], axis=1)
                by_id = np.argsort(own, axis=1, kind="stable")
                own, near = np.take_along_axis(own, by_id, 1), np.take_along_axis(near, by_id, 1)
                best = np.argsort(-near, axis=1, kind="stable")[:, :n]  # not-a-number, of zero vectors, last
                held = np.take_along_axis(own, best, 1), np.take_along_axis(near, best, 1)
        if held is not None:
            ok = ~np.isnan(held[1])
            yield pa.record_batch([pa.array(np.broadcast_to(ids[:, None], ok.shape)[ok]), pa.array(held[0][ok].tolist(), pa.string() if kind == "string" else pa.int64()), pa.array(held[1][ok])], ["query_id", "id", "similarity"])

    return each


def semantic_leg(query_vectors: DataFrame, vectors: DataFrame, n: int = LEG) -> DataFrame:
    """(query_id, id, similarity, place): exact nearest neighbours of a stated set of queries against all vectors.

    Queries go to the vectors in blocks of QUERY_BLOCK; each task keeps its n nearest alone, so that no more is shuffled. Scores
    are rounded to nine digits, so that ties do not depend on the order of additions. Vectors have the queries' size.
    """
    spark, kind = vectors.sparkSession, vectors.schema["id"].dataType.simpleString()
    asked = query_vectors.select("query_id", "embedding").filter("embedding is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()
        if not block.num_rows:
            continue
        size = len(block.column("embedding")[0])
        rows = vectors.filter(F.size("embedding") == size).select("id", "embedding").mapInArrow(_nearest(block, n, kind), f"query_id long, id {kind}, similarity double")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], f"query_id long, id {kind}, similarity double")
    order = [F.desc("similarity"), F.col("id")]
    return first(numbered(found, ["query_id"], order, "place"), ["query_id"], order, n)


#: Characters of the parts by which texts and the names that hold them meet.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda k: F.substring(text, k, size)))


def name_leg(queries: DataFrame, symbols: DataFrame, n: int = LEG) -> DataFrame:
    """(query_id, id, rank, place): exact, caseless, prefix and inner matches of names.

    A query meets the names that hold the rarest of its parts of GRAM characters (a shorter query: itself), and only these are compared.
    """
    # Names are few against symbols: each distinct (name, qualified name) is scored once.
    names = cut(symbols.select("name", "qualified_name").distinct().withColumn("name_id", F.xxhash64("name", "qualified_name")))
    q = cut(queries.filter("query != ''").select("query_id", "query", F.lower("query").alias("low")).withColumn("size", F.least(F.length("low"), F.lit(GRAM))))
    sizes = [r["size"] for r in q.select("size").distinct().collect()]  # GRAM of them at most
    low = F.array(F.lower("name"), F.lower("qualified_name"))
    held = names.select("name_id", F.explode(F.array_distinct(F.flatten(F.transform(low, lambda x: F.concat(*[_grams(x, F.lit(s)) for s in sizes] or [F.array().cast("array<string>")]))))).alias("gram"))
    held = cut(held)
    asked = q.select("query_id", F.explode(_grams(F.col("low"), F.col("size"))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A part that no name has rules the query out.
    rare = first(asked.join(often, "gram", "left"), ["query_id"], [F.coalesce("n", F.lit(0)), F.col("gram")]).select("query_id", "gram")
    met = q.join(rare, "query_id").join(held, "gram").join(names, "name_id")
    scored = met.select("query_id", "name", "qualified_name", name_score(F.col("name"), F.col("qualified_name"), F.col("query")).alias("rank")).filter("rank is not null")
    found = symbols.select("id", "name", "qualified_name").join(scored, ["name", "qualified_name"]).select("query_id", "id", "rank")
    order = [F.desc("rank"), F.col("id")]
    return first(numbered(found, ["query_id"], order, "place"), ["query_id"], order, n)


def ranked(legs: dict[str, DataFrame], symbols: DataFrame, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """(query_id, place, id, kind, score): legs fused, boosted by kind, candidates without a symbol dropped, then cut."""
    fused = fuse([(leg, WEIGHTS[name]) for name, leg in legs.items()], k)
    scored = fused.join(symbols.select("id", "kind", "qualified_name"), "id").withColumn("score", F.round(F.col("score") * kind_boost(F.col("kind")), 9))
    order = [F.desc("score"), F.col("id")]
    return first(numbered(scored, ["query_id"], order, "place"), ["query_id"], order, limit)


def hybrid(queries: DataFrame, query_vectors: DataFrame, symbols: DataFrame, vectors: DataFrame, limit: int = 10, repo: str | None = None, kind: str | None = None, language: str | None = None) -> DataFrame:
    """The results of hybrid_legs()."""
    return hybrid_legs(queries, query_vectors, symbols, vectors, limit, repo, kind, language)[0]


def hybrid_legs(queries: DataFrame, query_vectors: DataFrame, symbols: DataFrame, vectors: DataFrame, limit: int = 10, repo: str | None = None, kind: str | None = None, language: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Search with optional filters, and its legs; each filter applies to every leg, before ranks are given."""
    for name, value in (("repo", repo), ("kind", kind), ("language", language)):
        if value is not None:
            symbols = symbols.filter(F.col(name) == value)
    if (repo, kind, language) != (None, None, None):
        vectors = vectors.join(symbols.select("id"), "id", "left_semi")
    legs = {"fts": lexical_leg(queries, postings(symbols)), "semantic": semantic_leg(query_vectors, vectors), "name": name_leg(queries, symbols)}
    return ranked({k: v.select("query_id", "id", "place") for k, v in legs.items()}, symbols, limit), legs


def trace(legs: dict[str, DataFrame]) -> DataFrame:
    """(stage, query_id, id, place): the legs as one table."""
    parts = [leg.select(F.lit(name).alias("stage"), "query_id", "id", "place") for name, leg in legs.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
