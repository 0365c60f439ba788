"""Token-ID output: Parquet list columns in ascending doc_id order, and selective reads of them.

Texts are dealt out by ranges of (doc_id, hash of the text), sorted within each range, encoded, and written by Spark's
Parquet writer, whose commit protocol survives lost tasks. Ids are dictionary-encoded (the whole vocabulary fits one
dictionary page), doc_id and the counts are delta-encoded, row groups have a set size, and the writer's page indexes
let a reader with a filter on doc_id skip pages. A row also carries its partition and the ids before it there, so that
the place of every document in the whole sequence follows from one row per partition.

Null text is an empty document (its end id alone). Null doc_ids come first. Rows that share a doc_id follow each other in
the order of their texts' hash; equal rows take any order, which shows in no result. An empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenize import default_vocabulary, encoder

END_ID = 0
#: Bytes of a row group and rows of a page: small enough that a page index is worth reading, large enough to stream.
ROW_GROUP_BYTES, PAGE_ROWS = 32 << 20, 2_000

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode docs (doc_id, text) into files at path, in ascending doc_id order over the files' names."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = TaskContext.get().partitionId(), 0
        for batch in common.batches(parts, limit=common.BATCH_BYTES // 4):
            ids, counts = encoder(vocabulary).encode(common.column(batch, "text"), END_ID)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.record_batch([common.column(batch, "doc_id"), pa.array(np.full(len(counts), own, np.int32)), pa.array(starts), pa.array(counts), lists(ids, counts)], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    tie = F.xxhash64("text")
    dealt = common.texts(docs).withColumn("_tie", tie).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    options = {
        "compression": "lz4_raw", "parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#start_in_part": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    dealt.mapInArrow(encode, FILE_SCHEMA).write.options(**options).parquet(path)


def read_ids(spark, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """The rows of documents first to last; without ids, only the metadata columns are read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows if ids else rows.drop("ids")


def placed(spark, path: str, rows: DataFrame) -> DataFrame:
    """rows of read_ids with start: the ids of all documents before each. Partitions, not documents, meet on the driver."""
    totals = read_ids(spark, path, ids=False).groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n")).collect()
    sums, before = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        sums.append((part, before))
        before += n
    offsets = spark.createDataFrame(sums, "part int, _before long")
    # One row per file: bounded by the number of partitions of the write.
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("start_in_part")).drop("_before")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids read, as little-endian unsigned 32-bit integers."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = common.column(batch, "ids")
            flat, at = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([common.column(batch, "doc_id"), common.column(batch, "start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of docs to the shared folder and return doc_id, start, n_tokens, ids_crc32 from the files."""
    spark = docs.sparkSession
    path = common.scratch(spark, "token-ids")
    write_ids(docs, path, vocabulary)
    return checksums(placed(spark, path, read_ids(spark, path)))
