"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the byte n-grams, three to five long, of lower-cased words with a space at either end, hashed to
2 ** BUCKET_BITS buckets; a document has a feature or it has not. Training, on a bounded sample of labelled documents:

1. each training document's features are found by executors, which also count them by class;
2. a feature's log-count ratio is log((p + 1) / (P + 2)) - log((n + 1) / (N + 2)), brought SHRINK standard errors nearer to
   zero, and zero where it is within these: such a feature's x * r is zero in all documents. No feature is dropped otherwise,
   and none at all with shrink = 0;
3. logistic regression with an L2 penalty on x * r, on the driver, over the bounded sample.

A text's score is the logistic of the sum of its features' weights: one lookup table, applied to a slice's distinct
words and from these to its documents. Null text is empty; an empty text scores the intercept. Rows with repeated or null ids are
scored one by one; of several labelled texts with one id, that with the least list of features is learned from, whatever the order
of rows. Without labels of both classes, as with empty tables, every text scores the share of label 1 in the sample (0.5
where there is none). Only the id, the text and the label are read, so other columns may have any name. Texts are looked
at in slices of SLICE_BYTES, and a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
BUCKET_BITS = 20
#: Text bytes that are looked at together.
SLICE_BYTES = 1 << 20
#: Entries of the sample that a step of the regression looks at together.
ENTRIES = 1 << 20
#: Standard errors by which ratios are brought nearer to zero.
SHRINK = 3.0
PENALTY = 1.0
STEPS = 200
GRAMS = (3, 4, 5)
THRESHOLD = 0.3


@dataclass
class Model:
    index: np.ndarray  # kept buckets, ascending
    weight: np.ndarray
    intercept: float


def word_grams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) for all n-grams of all words of vocab."""
    raw, at = common.flat(vocab)
    n = len(vocab)
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    shift = np.repeat(np.arange(n), np.diff(at))
    padded[np.arange(len(raw)) + 2 * shift + 1] = raw
    begin = at[:-1] + 2 * np.arange(n)
    owner = np.repeat(np.arange(n), np.diff(at) + 2)
    room = np.repeat(begin + np.diff(at) + 2, np.diff(at) + 2) - np.arange(len(padded))  # bytes from here to the word's end
    words, buckets = [], []
    code = np.zeros(len(padded), np.uint64)
    for k in range(max(GRAMS)):
        code[: len(code) - k] |= padded[k:].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in GRAMS:
            fits = np.flatnonzero(room >= k + 1)
            words.append(owner[fits])
            buckets.append((common.mix64(code[fits] + np.uint64((k + 1) << 40)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


def features(texts: pa.Array, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature), sorted; features are buckets, or what slot maps them to where that isn't negative."""
    found = common.words(texts)
    word, bucket = word_grams(found.vocab)
    if slot is not None:
        kept = slot[bucket]
        has = kept >= 0
        word, bucket = word[has], kept[has].astype(np.int64)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    at = np.searchsorted(word, np.arange(len(found.vocab) + 1))
    many = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), np.diff(found.starts))
    has = many[found.codes] > 0
    pair = np.unique(doc[has].astype(np.int64) * max(1, len(found.vocab)) + found.codes[has])
    doc, code = np.divmod(pair, max(1, len(found.vocab)))
    each = many[code]
    place = np.arange(each.sum()) + np.repeat(at[code] - (np.cumsum(each) - each), each)
    pair = np.unique(np.repeat(doc, each) << BUCKET_BITS | bucket[place])
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


def in_slices(texts: pa.Array, slot: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """features() of one slice of texts after another, each with its number of texts."""
    for part in common.batches(iter([pa.record_batch([texts], ["text"])]), limit=SLICE_BYTES):
        yield part.num_rows, *features(common.column(part, "text"), slot)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, limit: int = MAX_TRAIN, shrink: float = SHRINK) -> Model:
    spark = docs.sparkSession
    path = common.scratch(spark, "toxicity")

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts):
            rows = []
            for n, doc, feature in in_slices(common.column(batch, "text")):
                at = np.searchsorted(doc, np.arange(n + 1))
                rows += [feature[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([common.column(batch, "doc_id"), common.column(batch, "y"), pa.array(rows, pa.binary())], ["doc_id", "y", "features"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in parts:
            for y, data in zip(common.column(batch, "y").to_pylist(), common.column(batch, "features").to_pylist(), strict=True):
                counts[y, np.frombuffer(data, "<u4")] += 1
        has = np.flatnonzero(counts.any(axis=0))
        yield pa.record_batch([pa.array(has), pa.array(counts[0, has]), pa.array(counts[1, has])], ["bucket", "neg", "pos"])

    sample = common.labelled(docs, labels, "toxic", modulus, held_out, limit).mapInArrow(mark, "doc_id long, y int, features binary")
    sample = common.settled(sample.groupBy("doc_id", "y").agg(F.min("features").alias("features")), path, compression="zstd")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    neg_n, pos_n = totals.get(0, 0), totals.get(1, 0)
    if not (neg_n and pos_n):
        share = (pos_n + 0.5) / (neg_n + pos_n + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 1) / (pos_n + 2)) - F.log((F.col("neg") + 1) / (neg_n + 2))
    error = F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    found = counts.select("bucket", (F.signum(ratio) * F.greatest(F.abs(ratio) - F.lit(shrink) * error, F.lit(0.0))).alias("r")).filter("r != 0")
    index, r = (c.to_numpy() for c in found.toArrow().sort_by("bucket").columns)  # 2 ** BUCKET_BITS rows at most

    def narrow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(1 << BUCKET_BITS, -1, np.int32)
        slot[index] = np.arange(len(index), dtype=np.int32)
        for batch in parts:
            cols = [slot[np.frombuffer(data, "<u4")] for data in common.column(batch, "features").to_pylist()]
            yield pa.record_batch([common.column(batch, "doc_id"), common.column(batch, "y"), pa.array([x[x >= 0].astype("<u4").tobytes() for x in cols], pa.binary())], ["doc_id", "y", "cols"])

    rows = sample.mapInArrow(narrow, "doc_id long, y int, cols binary").toArrow().sort_by("doc_id")
    y, cols = rows.column("y").to_numpy().astype(float), rows.column("cols").combine_chunks()
    size = pc.binary_length(cols).to_numpy().astype(np.int64) // 4
    weight, intercept = regress(size, common.flat(cols)[0].view("<u4"), y, r)
    return Model(index, weight * r, intercept)


def regress(size: np.ndarray, col: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the logistic loss of x * r plus PENALTY / 2 times the squared weights, by Adam.

    Document d has the next size[d] numbers of col.
    """
    n, k = len(y), len(r)
    ends = np.cumsum(size)
    cuts = [0]
    while cuts[-1] < n:
        begun = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, begun + ENTRIES, "right"))))
    w, b = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, STEPS + 1):
        by_col, g, gb = w * r, np.zeros(k), 0.0
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own, doc = col[ends[i] - size[i] : ends[j - 1]], np.repeat(np.arange(j - i), size[i:j])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, by_col[own], j - i) + b, -30, 30)))
            err = p - y[i:j]
            g += np.bincount(own, err[doc], k)
            gb += err.sum()
        g, gb = (g * r + PENALTY * w) / n, gb / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1, 3 * (STEPS - step + 1) / STEPS)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w, b


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[model.index] = np.arange(len(model.index), dtype=np.int32)
    raw = [np.zeros(0)]
    for n, doc, feature in in_slices(texts, slot):
        raw.append(np.bincount(doc, model.weight[feature], n) + model.intercept if len(model.index) else np.full(n, model.intercept))
    return 1 / (1 + np.exp(-np.clip(np.concatenate(raw), -30, 30)))


def score(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts):
            yield pa.record_batch([common.column(batch, "doc_id"), pa.array(scores(common.column(batch, "text"), model))], ["doc_id", "score"])

    found = common.texts(docs).mapInArrow(each, "doc_id long, score double")
    return found.select("doc_id", (common.id_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score under THRESHOLD."""
    return docs.filter(common.scored(docs, lambda texts: scores(texts, model)) < THRESHOLD)
