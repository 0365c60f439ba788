"""Sampled segmentations into SentencePiece pieces, and their lossless decoding.

A text's bytes form a lattice: its nodes are places between bytes, its arcs the pieces of a model that fit there, and byte
pieces for characters that no piece covers. An arc weighs 1 / (rank + RANK_SHIFT) ** theta, where rank is the piece's place
in the model's order of merges (byte pieces come last). Forward filtering sums the weights of all paths to each node;
backward sampling starts at the end and picks each arc by its share of its end's sum, so a whole segmentation has
the probability of its weights' product over the sum for all segmentations. The random numbers come from the row's key and the byte
places alone: the same row gives the same pieces wherever and beside whatever it is computed.

No piece crosses the beginning of a run of spaces, or a line feed, so the lattice falls apart there into chunks; the forward sums
of a batch's distinct chunks are computed once, all chunks side by side, and all occurrences sample side by side.

Spaces are the model's U+2581; that character itself, in a text, is spelled in byte pieces, and no dummy space is added:
decoding gives back every text. Null text is empty and has no pieces. Rows that share a key and a text have the same pieces, and
null keys count as the key -1. Only the id and the text are read, so other columns may have any name; an empty table gives no rows.
A worker holds some 100 bytes a byte of distinct chunks, of a batch or of one longer text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .token_files import lists
from .tokenize import spread

THETA = 1.0
SEED = 20_260_101
RANK_SHIFT = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces as bytes, and a dense transition table over them."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        content, weight, trie, self.byte_id = [b""] * n, np.zeros(n), {}, np.zeros(256, np.int64)
        for k in range(n):
            piece = model.id_to_piece(k)
            rank = float(n)
            if model.is_byte(k):
                content[k] = bytes([int(piece[3:5], 16)])
                self.byte_id[content[k][0]] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                content[k] = piece.replace("▁", " ").encode()
                trie[content[k]] = k
                rank = -model.get_score(k)
            weight[k] = -theta * np.log(rank + RANK_SHIFT)
        self.weight = weight
        #: Whether chunks may begin at spaces after other bytes, and at line feeds.
        self.cut_spaces = not any(b" " in x.lstrip(b" ") for x in trie)
        self.cut_lines = not any(b"\n" in x for x in trie)
        node = {b"": 1}
        for x in trie:
            for k in range(1, len(x) + 1):
                node.setdefault(x[:k], len(node) + 1)
        self.step = np.zeros((len(node) + 1, 256), np.int32)
        self.piece = np.full(len(node) + 1, -1, np.int32)
        for x, k in node.items():
            if x:
                self.step[node[x[:-1]], x[-1]] = k
            self.piece[k] = trie.get(x, -1)
        self.longest = max(map(len, trie))
        self.size = np.array([len(x) for x in content], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.content = np.frombuffer(b"".join(content), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after another, and where each begins (one more at the end)."""
        size = self.size[ids]
        out = self.content[spread(self.begin[ids], size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        return out, sums[np.concatenate([[0], np.cumsum(counts)])]

    def lattice(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks raw[at[k]:at[k + 1]]: arcs sorted by end node, as begin nodes, pieces, shares added up within an end node,
        and each node's first arc. Chunk k's nodes are at[k] + k to at[k + 1] + k."""
        n = len(raw)
        chunk = np.repeat(np.arange(len(at) - 1), np.diff(at))
        room = at[1:][chunk] - np.arange(n)
        place, state = np.arange(n), np.ones(n, np.int64)
        begins, sizes, ids = [], [], []
        for k in range(self.longest):
            fits = room[place] > k
            place, state = place[fits], state[fits]
            state = self.step[state, raw[place + k]]
            live = state > 0
            place, state = place[live], state[live]
            if not len(place):
                break
            whole = self.piece[state] >= 0
            begins.append(place[whole])
            sizes.append(np.full(int(whole.sum()), k + 1))
            ids.append(self.piece[state[whole]])
        begin, size, piece = np.concatenate([*begins, np.zeros(0, np.int64)]), np.concatenate([*sizes, np.zeros(0, np.int64)]), np.concatenate([*ids, np.zeros(0, np.int64)])
        # Characters that are no pieces themselves are spelled in bytes.
        lead = (raw & 0xC0) != 0x80
        first = np.maximum.accumulate(np.where(lead, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        width = np.diff(np.append(np.flatnonzero(lead), n))
        covered = np.zeros(n, bool)
        own = np.zeros(n, np.int64)
        own[lead] = width
        covered[begin[size == own[begin]]] = True
        spelt = np.flatnonzero(~covered[first]) if n else np.zeros(0, np.int64)
        begin, size, piece = np.concatenate([begin, spelt]), np.concatenate([size, np.ones(len(spelt), np.int64)]), np.concatenate([piece, self.byte_id[raw[spelt]]]).astype(np.int64)
        depth = begin + size - at[chunk[begin]]
        begin = begin + chunk[begin]
        end = begin + size
        order = np.lexsort((end, depth))
        begin, end, piece, depth = begin[order], end[order], piece[order], depth[order]
        weight, total = self.weight[piece], np.zeros(n + len(at) - 1)
        share = np.zeros(len(begin))
        levels = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            e = end[a:b]
            new = np.flatnonzero(np.diff(e, prepend=-1))
            x = total[begin[a:b]] + weight[a:b]
            top = np.maximum.reduceat(x, new)
            many = np.diff(np.append(new, b - a))
            sums = np.add.reduceat(np.exp(x - np.repeat(top, many)), new)
            total[e[new]] = top + np.log(sums)
            share[a:b] = x
        share = np.exp(share - total[end])
        order = np.argsort(end, kind="stable")
        begin, end, piece, share = begin[order], end[order], piece[order], share[order]
        node_first = np.searchsorted(end, np.arange(len(total) + 1))
        # Added up within each node alone: a share is the same whatever other chunks are there.
        many = np.diff(node_first)
        at, run = np.flatnonzero(many), np.zeros(int((many > 0).sum()))
        for k in range(int(many.max(initial=0))):
            more = many[at] > k
            at, run = at[more], run[more]
            run = run + share[node_first[at] + k]
            share[node_first[at] + k] = run
        return begin, piece, share, node_first

    def sample(self, texts: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts one after another, and how many each has."""
        raw, at = common.flat(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        cut = np.zeros(len(raw), bool)
        if self.cut_spaces:
            cut[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
        if self.cut_lines:
            cut |= raw == 10
            cut[1:] |= raw[:-1] == 10
        cut[at[:-1][np.diff(at) > 0]] = True
        begins = np.flatnonzero(cut)
        sizes = np.diff(np.append(begins, len(raw)))
        coded = common.binary_array(raw, sizes).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunks, chunk_at = common.flat(coded.dictionary)
        arc_begin, arc_piece, arc_sum, node_first = self.lattice(chunks, chunk_at)
        doc = np.searchsorted(at, begins, "right") - 1
        start = chunk_at[code] + code  # the first node of each occurrence's chunk
        node, live = start + sizes, np.arange(len(code))
        place = (begins - at[doc]).astype(np.int64) - start  # added to a node: its byte place in the text
        key = common.mix64(keys[doc].astype(np.uint64) + np.uint64(seed))
        steps, made = [], np.zeros(len(code), np.int64)
        while len(live):
            now = node[live]
            with np.errstate(over="ignore"):
                u = (common.mix64(key[live] ^ common.mix64((now + place[live]).astype(np.uint64))) >> np.uint64(11)).astype(float) * 2.0**-53
            arc, last = node_first[now], node_first[now + 1] - 1
            more = np.flatnonzero((u >= arc_sum[arc]) & (arc < last))
            while len(more):
                arc[more] += 1
                more = more[(u[more] >= arc_sum[arc[more]]) & (arc[more] < last[more])]
            steps.append((live, arc_piece[arc], made[live].copy()))
            made[live] += 1
            node[live] = arc_begin[arc]
            live = live[node[live] > start[live]]
        out = np.zeros(int(made.sum()), np.int32)
        after = np.cumsum(made)
        for who, piece, k in steps:
            out[after[who] - 1 - k] = piece
        sums = np.concatenate([[0], after])
        return out, np.diff(sums[np.searchsorted(begins, at)])


@cache
def pieces(path: str, theta: float = THETA) -> Pieces:
    """One per Python worker and model."""
    return Pieces(path, theta)


def _sampled(batch: pa.RecordBatch, path: str, theta: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    keys = common.column(batch, "doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
    return pieces(path, theta).sample(common.column(batch, "text"), keys.view(np.uint64) if keys.dtype == np.int64 else keys, seed)


def encode(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids): a sampled segmentation of each text."""
    path = path or default_model()
    common.bound_batches(docs.sparkSession)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts, limit=common.BATCH_BYTES // 4):
            ids, counts = _sampled(batch, path, theta, seed)
            yield pa.record_batch([common.column(batch, "doc_id"), lists(ids, counts)], ["doc_id", "ids"])

    return common.texts(docs).mapInArrow(each, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of encode()."""
    path = path or default_model()

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = common.column(batch, "ids")
            raw, at = pieces(path).decode(np.asarray(ids.flatten()), np.asarray(ids.value_lengths()))
            yield pa.record_batch([common.column(batch, "doc_id"), common.binary_array(raw, np.diff(at)).cast(pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, lossless): each text's sampled pieces, and what they decode to."""
    path = path or default_model()
    common.bound_batches(docs.sparkSession)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts, limit=common.BATCH_BYTES // 4):
            ids, counts = _sampled(batch, path, theta, seed)
            raw, at = pieces(path).decode(ids, counts)
            texts, text_at = common.flat(common.column(batch, "text"))
            data, back, given = (memoryview(np.ascontiguousarray(x)).cast("B") for x in (ids.astype("<u4"), raw, texts))
            ends = np.concatenate([[0], np.cumsum(counts)])
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), text_at[:-1].tolist(), text_at[1:].tolist(), strict=True))
            digest = [hashlib.sha256(back[a:b]).hexdigest() for a, b, _, _ in spans]
            same = [back[a:b] == given[c:d] for a, b, c, d in spans]
            yield pa.record_batch([common.column(batch, "doc_id"), pa.array(counts), pa.array(crc, pa.int64()), pa.array(digest), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return common.texts(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
