"""Quality: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

A text becomes the FEATURES below. Each feature is cut into bins at quantiles of a bounded sample of labelled documents. Boosting
goes round the features in turn: a tree with few leaves is fitted to the gradients of the logistic loss summed by bin,
and its leaves are added to the feature's lookup table. Then the pairs of features whose two-way cuts explain most of
what is left get tables of their own in the same way. A score is the logistic of the intercept and one table entry per
feature and pair: binning by binary search and additions of whole columns.

Null text is empty. Features of an empty text are zero, and it is scored like any other, as are rows with repeated or null
ids: one row for each row, equal texts with equal scores. Of several labelled texts with one id that with the least features
is learned from, whatever the order of rows. Without labels of both classes every text scores the share of label 1 in
the sample (0.5 where there is none, as with empty tables). Only the id, the text and the label are read, so other columns may have any
name. Texts are looked at in slices of SLICE_BYTES; a longer one alone, for which a worker holds some 30 bytes a byte of its longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS = 120, 40
PAIRS = 12
RATE = 0.1
LEAVES = 3
#: Added to a leaf's second derivatives.
DAMP = 4.0
THRESHOLD = 0.5

FEATURES = (
    "log_words", "word_length", "upper", "digits", "punctuation", "white_space", "non_ascii", "symbols", "bars", "shouts",
    "words_a_line", "distinct_words", "top_word", "repeats", "distinct_pairs", "duplicate_lines", "sentence_ends", "capitals", "short_words", "entropy", "longest_word",
)

_UPPER, _DIGIT, _PUNCT, _SYMBOL, _ALPHA = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[*b".,;:!?'\"()-"]] = True
_SYMBOL[[*b"#$%&*+/<=>@\\^_`{|}~[]"]] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


#: Text bytes, and texts, that are looked at together: what a worker holds beside its batch follows from these, or from one longer text.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2048
#: Classes of bytes whose shares are features, by histogram.
_CLASSES = np.stack([_UPPER, _ALPHA, _DIGIT, _PUNCT, common.SPACE, np.arange(256) >= 128, _SYMBOL, np.arange(256) == 124, np.arange(256) == 33, np.arange(256) == 10], axis=1).astype(np.int64)


def featurise(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text, from the whole text; a text's row is the same beside whatever others it is computed."""
    out = [np.zeros((0, len(FEATURES)))]
    for part in common.batches(iter([pa.record_batch([texts], ["text"])]), limit=SLICE_BYTES):
        for at in range(0, part.num_rows, SLICE_ROWS):
            out.append(_featurise(common.column(part.slice(at, SLICE_ROWS), "text")))
    return np.concatenate(out)


def histograms(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each text has each byte."""
    out = np.zeros((len(at) - 1, 256), np.int64)
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for k in range(a, b, SLICE_BYTES):
            out[d] += np.bincount(raw[k : min(b, k + SLICE_BYTES)], minlength=256)
    return out


def _featurise(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    raw, at = common.flat(texts)
    size = np.diff(at)
    begins, ends, starts = common.word_spans(raw, at)
    words = np.diff(starts)
    doc = np.repeat(np.arange(n, dtype=np.int32), words)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n)

    seen = histograms(raw, at)
    upper, alpha, digits, punctuation, white, high, symbols, bars, shouts, feeds = (seen @ _CLASSES).T
    lines = feeds + 1
    length = (ends - begins).astype(np.int32)
    last, head = raw[ends - 1], raw[begins]
    del begins, ends
    coded = common.words(texts)
    code, v = coded.codes.astype(np.int64), max(1, len(coded.vocab))
    del coded
    pair, count = np.unique(doc * np.int64(v) + code, return_counts=True)
    distinct = np.bincount(pair // v, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pair // v, count)
    del pair, count
    same = doc[1:] == doc[:-1]
    repeats = np.bincount(doc[1:][same & (code[1:] == code[:-1])], minlength=n)
    # A slice, or a longer text alone, has so few words that a text and two words fit one number.
    two = np.unique(((doc[1:] * np.int64(v) + code[1:]) * v + code[:-1])[same])
    kinds = np.bincount(two // (v * v), minlength=n)
    del two, code
    twice = np.zeros(n)
    for d, t in enumerate(texts):
        rows = (t.as_py() or "").split("\n")
        twice[d] = 1 - len(set(rows)) / len(rows)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    byte = seen / np.maximum(size, 1)[:, None]
    entropy = -(byte * np.log2(np.where(byte > 0, byte, 1))).sum(axis=1)
    out = [
        np.log1p(words), _share(size, words), _share(upper, alpha), _share(digits, size), _share(punctuation, size), _share(white, size), _share(high, size), _share(symbols, size), _share(bars, words), _share(shouts, words),
        _share(words, lines), _share(distinct, words), _share(top, words), _share(repeats, words), _share(kinds, words - 1), twice, _share(per_word(np.isin(last, [33, 46, 63])), words), _share(per_word(_UPPER[head]), words), _share(per_word(length <= 3), words), entropy, np.log1p(longest),
    ]
    return np.column_stack(out).astype(float)


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # i, j, edges of i, of j, table


def leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By bin, the value of a tree with up to LEAVES leaves over ordered bins: greedy best cuts of gradient sums."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + DAMP)

    for _ in range(LEAVES - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = worth(a, mid) + worth(mid, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], a + 1 + k
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + DAMP)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A two-cut tree over a table of two features' bins: its values, and what it gains."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not (a.size and b.size):
        return np.zeros(g.shape), 0.0
    corners = [(0, a, 0, b), (0, a, b, -1), (a, -1, 0, b), (a, -1, b, -1)]
    part = lambda c, x, y, u, v: c[y, v] - c[x, v] - c[y, u] + c[x, u]
    gain = sum(part(cg, *c) ** 2 / (part(ch, *c) + DAMP) for c in corners)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    for r in (slice(0, i + 1), slice(i + 1, None)):
        for c in (slice(0, j + 1), slice(j + 1, None)):
            out[r, c] = -g[r, c].sum() / (h[r, c].sum() + DAMP)
    return out, float(gain[i, j] - g.sum() ** 2 / (h.sum() + DAMP))


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    cut = lambda k, bins: np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]))
    model.edges = [cut(k, BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    raw = np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            step = RATE * leaves(np.bincount(b, g, len(model.tables[k])), np.bincount(b, h, len(model.tables[k])))
            model.tables[k] += step
            raw += step[b]
    edges = [cut(k, PAIR_BINS) for k in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    g, h = slopes()

    def tabled(i, j, values):
        return np.bincount(small[i] * (len(edges[j]) + 1) + small[j], values, (len(edges[i]) + 1) * (len(edges[j]) + 1)).reshape(len(edges[i]) + 1, -1)

    ranked = sorted(((quadrants(tabled(i, j, g), tabled(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, edges[i], edges[j], np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for gain, i, j in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, t in model.pairs:
            g, h = slopes()
            step = RATE * quadrants(tabled(i, j, g), tabled(i, j, h))[0]
            t += step
            raw += step[small[i], small[j]]
    return model


def scores_of(x: np.ndarray, model: Model) -> np.ndarray:
    raw = np.full(len(x), model.intercept)
    for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)):
        raw += t[np.searchsorted(e, x[:, k], "right")]
    for i, j, a, b, t in model.pairs:
        raw += t[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, limit: int = MAX_TRAIN) -> Model:
    names = [f"f{k}" for k in range(len(FEATURES))]

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts):
            x = featurise(common.column(batch, "text"))
            yield pa.record_batch([common.column(batch, "doc_id"), common.column(batch, "y"), *(pa.array(c) for c in x.T)], ["doc_id", "y", *names])

    common.bound_batches(docs.sparkSession)
    sample = common.labelled(docs, labels, "quality", modulus, held_out, limit)
    found = sample.mapInArrow(each, "doc_id long, y int, " + ", ".join(f"{x} double" for x in names))
    rows = found.groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("f")).select("doc_id", "y", "f.*").toPandas().sort_values("doc_id")
    return learn(rows[names].to_numpy(float), rows["y"].to_numpy(float))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    return scores_of(featurise(texts), model)


def score(docs: DataFrame, model: Model, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts):
            yield pa.record_batch([common.column(batch, "doc_id"), pa.array(scores(common.column(batch, "text"), model))], ["doc_id", "score"])

    found = common.texts(docs).mapInArrow(each, "doc_id long, score double")
    return found.select("doc_id", (common.id_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score THRESHOLD or more."""
    return docs.filter(common.scored(docs, lambda texts: scores(texts, model)) >= THRESHOLD)
