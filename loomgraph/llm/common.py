"""What the training-data operators share: reading, shared scratch folders, Arrow batches and word scans."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder

#: Text bytes that a Python worker holds at once, in one Arrow batch.
BATCH_BYTES = 16 << 20
#: Numbers that mix64() mixes at once.
MIXED = 1 << 16


def hand_back() -> None:
    """Has a Python worker return what it has freed, which glibc and Arrow's pool would else keep beside all that comes later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Has the session hand Python at most BATCH_BYTES, or one row, at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share; see session.folder()."""
    bound_batches(spark)
    return folder(spark, label)


def settled(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    schema = df.schema
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text alone; null text counts as empty. Other columns, whatever their names, are left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def share_of(hashed: Column, share: float) -> Column:
    """Whether a row, by its hash, is in a sample of that share; it decides where rows go, never which rows count."""
    return F.pmod(hashed, F.lit(1 << 48)) < F.lit(int(min(1.0, share) * (1 << 48)))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; -1 for a null id."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(-1))


def batches(parts: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that a batch has about limit bytes of text, or one row."""
    for part in parts:
        if part.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(part.column(part.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < part.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield part.slice(at, stop - at)
            at = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts as one array, and where each begins (one more at the end)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Words:
    """The words of a batch of texts: codes[starts[d]:starts[d + 1]] index vocab for text d."""

    starts: np.ndarray
    codes: np.ndarray
    vocab: pa.Array


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that are not white space, within texts, and each text's first run."""
    gap = SPACE[raw]
    first = ~gap
    last = first.copy()
    if len(raw):
        edge = at[(at > 0) & (at < len(raw))]
        first[1:] &= gap[:-1]
        first[edge] = ~gap[edge]
        last[:-1] &= gap[1:]
        last[edge - 1] = ~gap[edge - 1]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, at)


def binary_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Words are [^\\x20\\x09-\\x0D]+ in UTF-8 bytes, with A-Z lower-cased when asked."""
    raw, at = flat(texts)
    begins, ends, starts = word_spans(raw, at)
    kept = raw[~SPACE[raw]]
    coded = binary_array(LOWER[kept] if lower else kept, ends - begins).dictionary_encode()
    return Words(starts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    out = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for a in range(0, len(out), MIXED):  # part by part, so that shifted copies stay small
            x = out[a : a + MIXED]
            x += np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """doc_id, text and y of at most `limit` labelled documents: those whose ids have the smallest hashes.

    Ids whose remainder is held_out, null ids, and labels other than 0 and 1 are left out; an id with several labels has
    the commoner one, and 1 when they are even. The sample is broadcast: `limit` bounds it.
    """
    ids = labels.select(labels["doc_id"].cast("long").alias("_id"), labels[label].cast("int").alias("_y"))
    ids = ids.filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (id_remainder(F.col("_id"), modulus) != held_out))
    ids = ids.groupBy("_id").agg(F.round(F.avg("_y")).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    return texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_y").alias("y"))


def scored(docs: DataFrame, score, text_col: str = "text", kind: str = "double") -> Column:
    """A column with what score makes of the texts of docs, batch by batch, next to all the other columns."""

    @F.arrow_udf(kind)
    def each(text: pa.Array) -> pa.Array:
        out = [np.zeros(0, float if kind == "double" else np.int64)]
        for part in batches(iter([pa.record_batch([text], ["text"])])):
            out.append(score(column(part, "text")))
        return pa.array(np.concatenate(out))

    return each(F.coalesce(docs[text_col], F.lit("")))


def hot_keys(counted: DataFrame, key: str, rows: int) -> DataFrame:
    """The keys of counted (key, n) that hold more rows than an even share of a great many; 20,000 keys at most have so many."""
    return counted.filter(F.col("n") > max(64, rows // 20_000)).select(key)


def join_hot(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows joined with facts, which has one row for each key, on key: hot keys' facts, whose number is bounded, go to where the
    rows are, and only the other rows are dealt out by key."""
    few = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    spread_out = rows.join(few, key)
    return spread_out.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key))
