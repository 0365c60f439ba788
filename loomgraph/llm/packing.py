"""Best-fit packing: planned over the histogram of lengths, then taken by rank within length.

1. Each text is encoded where it is read; its pieces (length at most the sequence's) get a rank among the pieces of the
   same length in their partition. Pieces, a few dozen bytes each, are written to the shared folder.
2. Pieces are counted by (partition, length); sums over partitions turn ranks in a partition into ranks in the table.
3. The driver plans best-fit-decreasing over the counts of at most 2048 lengths. Sequences that are alike stay one run
   (first sequence, how many, room left), so the plan's size depends on the histogram and not on the documents.
4. A piece's slot follows from its length and rank alone.

Null text is an empty document (its end id alone). Rows that share a doc_id are documents of their own. An empty table
gives no rows. Documents longer than a sequence are cut from their end, so only their first piece may be shorter. Pieces of equal length are
alike to the plan: which of them takes which slot follows from their tasks' order, and any numbers do. Only the id and the text
are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import default_vocabulary, encoder

SEQUENCE = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, sequence: int) -> DataFrame:

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in common.batches(parts, limit=common.BATCH_BYTES // 4):
            flat, counts = encoder(vocabulary).encode(common.column(batch, "text"), END_ID)
            data, begin, rows = memoryview(flat).cast("B"), 0, []
            for doc, n in zip(common.column(batch, "doc_id").to_pylist(), counts.tolist(), strict=True):
                at, k = 0, 0
                while at < n:
                    length = (n - at) % sequence or sequence
                    rows.append((doc, k, at, length, zlib.crc32(data[4 * (begin + at) : 4 * (begin + at + length)]), own, int(seen[length])))
                    seen[length] += 1
                    at, k = at + length, k + 1
                begin += n
            if rows:
                doc, k, at, length, crc, part, rank = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc)), pa.array(part, pa.int32()), pa.array(rank, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"])

    return common.texts(docs).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Best-fit-decreasing over counts by length.

    Rows of (length, first rank, pieces, pieces a sequence, first sequence, first offset), in order of length and rank:
    the piece of rank r is number (r - first rank) of its row, and fills the row's sequences one after another.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # by room left: first sequence, how many
    rooms: list[int] = []  # those that runs has, in ascending order
    rows: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            near = bisect_left(rooms, length)
            if near == len(rooms):
                room, each = sequence, sequence // length
                first, n = made, -(-left // each)
                made += n
            else:
                room = rooms[near]
                each = room // length
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.remove(room)
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, each, first, sequence - room))
                add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and 0 < left < each:
                rows.append((length, rank, left, left, first + whole, sequence - room))
                add(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            add(room, first + whole, n - whole)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    path = common.scratch(spark, "pieces")
    cut = common.settled(pieces(docs, vocabulary or default_vocabulary(), sequence), path, compression="zstd")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, sequence)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank_in_part")).alias("rank"))

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(slots[:, 1].max()) + 1 if len(slots) else 1
        keys = slots[:, 0] * span + slots[:, 1]
        for batch in parts:
            length, rank = (common.column(batch, x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            row = slots[np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1]
            nth = rank - row[:, 1]
            yield pa.record_batch([*(common.column(batch, x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(take, PLACED)
