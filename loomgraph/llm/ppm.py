"""Language-model scoring by prediction by partial matching over bytes.

A text is its words (A-Z lower-cased; runs of bytes other than white space), each followed by a space, and a line feed
at the end, which no word contains. The model predicts these bytes one by one from up to ORDER bytes before them in the
text, across words; before a text stand ORDER spaces. Word boundaries and the end mark are predicted too, so the scores are
probabilities of token sequences, as those of the base are. Above the bytes stands one longer context: the tokens fall into
segments (a token whose hash with the one before it is 0 modulo SEGMENT ends one), and a segment that followed the
same segment in training is predicted whole, which is what makes copied passages cheap; else it escapes to the bytes.

Training text is gathered whole, as counts that follow the corpus:

1. Blocks. A task's documents become blocks of their distinct words, of codes into them, and of the distinct
   (context, byte) pairs of their texts with training counts, written to the shared folder.
2. Words and pairs. The blocks' words are dealt out by hash, and so are their pairs. Each shard adds up training counts.
3. Trie. The pairs' sums are the deepest level of the context trie, one row a pair. A level below has, for each suffix of
   a context, the bytes that follow it, each counted once for every longer context it was new in (update exclusion).
   Escapes are estimated by absolute discounting: a context that was seen N times with D distinct bytes escapes
   with probability d * D / N, where d = n1 / (n1 + 2 n2) is estimated from the level's counts of counts. After an escape, the
   bytes that the longer context had are excluded: the shorter context's counts are renormalised without them. The last
   escape leads to the bytes that never occurred, all equally likely.
4. Segments. Pairs of (segment before, segment), as hashes, are dealt out by both hashes and counted in training text. Each shard
   sends on what its pairs add to the segment before: one row a shard and segment, whatever number of pairs follow it. These are dealt
   out by it and added up, and blocks are told the sums for the segments that they have. No segment's followers meet in one task.
5. Scores. Each pair gets its code length by joining levels; each shard sends every block the code lengths of its pairs
   or the counts of its words. Each block spells its documents again and adds up their bytes.

Nothing but level-wide constants meets on the driver. A block holds at most BLOCK_BYTES of text (or one document); there
are as many shards of segments and of pairs as the input has partitions, and a shard of words for every PARTITIONS_A_SHARD. Null text is empty: one end token. Rows that share a doc_id are scored
one by one; null doc_ids count as training text. Without training text every byte is equally likely.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenize import spread

ORDER = 5
#: Distinct symbols: the bytes.
SYMBOLS = 256
BLOCK_BYTES = 16 << 20
END = b"\n"

BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, codes binary, words array<struct<shard:int,code:binary,text:binary,size:binary,n:binary>>, pairs array<struct<shard:int,key:binary,n:binary>>, segments binary, n_segments array<long>, events array<struct<shard:int,at:binary,before:binary,segment:binary,train:binary>>, befores array<struct<shard:int,at:binary,before:binary>>, before_of binary"

SEGMENT = 16
#: Hashes of the end mark and of what stands before a document. Fixed values.
END_HASH, START_HASH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: Partitions of the input for each shard of words.
PARTITIONS_A_SHARD = 4
#: Bytes of a block that are looked at together.
SLICE = 1 << 20


def _binary(values: np.ndarray) -> bytes:
    """Packed before it is shuffled or written; Spark's own codec leaves counts and codes at twice the size."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _array(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _turned(values: np.ndarray) -> bytes:
    """Like _binary, with the values' first bytes together, then their second bytes, and so on."""
    return _binary(np.ascontiguousarray(values).view("u1").reshape(len(values), values.itemsize).T)


def _unturned(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(_array(data, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def dealt(key: np.ndarray, n_shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards that keys fall into, each with its keys' places in order."""
    shard = (key % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
    return ((k, order[a:b]) for k, a, b in zip(range(n_shards), cut[:-1], cut[1:], strict=True) if a < b)


def word_hashes(words: pa.Array) -> np.ndarray:
    raw, at = common.flat(words)
    size = np.diff(at)
    with np.errstate(over="ignore"):
        place = (spread(np.zeros(len(size), np.int64), size) + 1).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix64(raw.astype(np.uint64) + (place << np.uint64(8))))])
        return common.mix64(sums[at[1:]] - sums[at[:-1]])


def segments(token: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of token hashes, with each document's first token: segments' first tokens, hashes and predecessors, and first segments."""
    n = len(token)
    with np.errstate(over="ignore"):
        first = np.zeros(n, bool)
        for a in range(1, n - 1, common.MIXED):  # part by part, so that little more than the tokens is held
            b = min(a + common.MIXED, n - 1)
            first[a + 1 : b + 1] = common.mix64(token[a:b] + token[a - 1 : b - 1] * _FACTOR) % np.uint64(SEGMENT) == 0
        first[0] = True
        first[begins] = True
        at = np.flatnonzero(first)
        own = np.zeros(len(at), np.uint64)
        a = 0
        while a < len(at):  # whole segments
            b = max(a + 1, int(np.searchsorted(at, at[a] + common.MIXED)))
            end = at[b] if b < len(at) else n
            place = np.arange(at[a], end) - np.repeat(at[a:b], np.diff(np.append(at[a:b], end)))
            own[a:b] = np.add.reduceat(common.mix64(token[at[a] : end] + place.astype(np.uint64) * _FACTOR), at[a:b] - at[a])
            a = b
        own = common.mix64(own)
    before = np.concatenate([[START_HASH], own[:-1]])
    doc_first = np.searchsorted(at, begins)
    before[doc_first] = START_HASH
    return at, own, before, doc_first


def pair_key(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix64(before * _FACTOR + own)


def _structs(rows: list[dict], names: tuple[str, ...]) -> pa.Array:
    return pa.array(rows, pa.struct([("shard", pa.int32()), *((x, pa.binary()) for x in names)]))


def blocks(docs: DataFrame, modulus: int, held_out: int, n_words: int, n_events: int) -> DataFrame:
    """One row per block: its documents, the codes of their words one after another, and its words and pairs with their training counts."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        common.hand_back()

        def flush() -> pa.RecordBatch:
            text, ids, out = (pa.concat_arrays([common.column(x, y) for x in held]) for y in ("text", "doc_id", "held_out"))
            held.clear()
            found = common.words(text)
            del text
            n = np.diff(found.starts)
            raw, raw_at = common.flat(found.vocab)
            stream, _, doc_at = spelling(found.codes, n, raw, raw_at[:-1], np.diff(raw_at))
            key, key_n = distinct(stream, doc_at, ~np.asarray(out))
            del stream
            grams = [{"shard": k, "key": _turned(np.diff(key[x], prepend=0)), "n": _turned(key_n[x].astype("<u4"))} for k, x in dealt(common.mix64(key), n_events)]
            del key, key_n
            train = ~np.repeat(np.asarray(out), n)
            counts = np.bincount(found.codes[train], minlength=len(found.vocab))
            hashes = word_hashes(found.vocab)
            common.hand_back()
            token = np.full(len(found.codes) + len(n), END_HASH)
            token[np.arange(len(found.codes)) + np.repeat(np.arange(len(n)), n)] = hashes[found.codes]
            begins = np.cumsum(n + 1) - (n + 1)
            del train
            at, own, before, doc_first = segments(token, begins)
            n_tokens = len(token)
            del token
            in_train = ~np.repeat(np.asarray(out), np.diff(np.append(doc_first, len(at))))

            words = []
            for k, x in dealt(hashes, n_words):
                text, text_at = common.flat(found.vocab.take(pa.array(x)))
                words.append({"shard": k, "code": _binary(x.astype("<u4")), "text": _binary(text), "size": _binary(np.diff(text_at).astype("<u4")), "n": _binary(counts[x].astype("<u4"))})
            events = [{"shard": k, "at": _binary(x.astype("<u4")), "before": _binary(before[x]), "segment": _binary(own[x]), "train": _binary(in_train[x].astype(np.uint8))} for k, x in dealt(pair_key(before, own), n_events)]
            few, before_of = np.unique(before, return_inverse=True)
            befores = [{"shard": k, "at": _binary(x.astype("<u4")), "before": _binary(few[x])} for k, x in dealt(few, n_events)]
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            row = [
                pa.array([uuid.uuid4().int >> 65]), one(ids), one(out), one(pa.array(n + 1)), pa.array([_binary(found.codes.astype("<u4"))], pa.binary()), one(_structs(words, ("code", "text", "size", "n"))), one(_structs(grams, ("key", "n"))),
                pa.array([_binary(np.diff(np.append(at, n_tokens)).astype("<u4"))], pa.binary()), one(pa.array(np.diff(np.append(doc_first, len(at))))), one(_structs(events, ("at", "before", "segment", "train"))),
                one(_structs(befores, ("at", "before"))), pa.array([_binary(before_of.astype("<u4"))], pa.binary()),
            ]
            return pa.record_batch(row, [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in common.batches(parts):
            more = len(common.flat(common.column(batch, "text"))[0])
            if held and size + more > BLOCK_BYTES:
                yield flush()
                common.hand_back()
                size = 0
            held.append(batch)
            size += more
        if held:
            yield flush()
            common.hand_back()

    rows = common.texts(docs).withColumn("held_out", common.id_remainder(F.col("doc_id"), modulus) == held_out)
    return rows.mapInArrow(make, BLOCKS)


# Words and pairs ------------------------------------------------------------------------------------------------------


def keys_at(stream: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Of each byte of stream[begin:end]: ORDER bytes of context, then the byte."""
    key = np.zeros(end - begin, np.int64)
    for k in range(ORDER + 1):
        key |= stream[begin - k : end - k].astype(np.int64) << (8 * k)
    return key


def pairs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) for each byte of each word and the space after it, each word as a text of its own without its end mark."""
    raw, at = common.flat(words)
    size = np.diff(at)
    n = len(words)
    padded = np.full(len(raw) + n * (ORDER + 1), 32, np.uint8)
    begin = at[:-1] + (ORDER + 1) * np.arange(n) + ORDER
    padded[spread(begin, size)] = raw
    count = size + 1
    return np.repeat(np.arange(n), count), keys_at(padded, ORDER, len(padded))[spread(begin, count) - ORDER]


def spelling(codes: np.ndarray, n_words: np.ndarray, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of documents of n_words words each, one after another with ORDER spaces before each, and where tokens and documents begin.

    codes index words, which are the sizes bytes of raw at begins.
    """
    last = np.cumsum(n_words + 1) - 1
    is_word = np.ones(len(codes) + len(n_words), bool)
    is_word[last] = False
    size = np.ones(len(is_word), np.int32)
    size[is_word] += sizes[codes].astype(np.int32)
    size[last] += ORDER  # the spaces before the next document
    at = np.cumsum(size, dtype=np.int64)
    stream = np.full(at[-1], 32, np.uint8)
    at += ORDER - size
    del size
    stream[at[last]] = END[0]
    to, a = at[is_word], 0
    del is_word
    while a < len(codes):
        b = max(a + 1, int(np.searchsorted(to, to[a] + SLICE)))
        x = codes[a:b]
        stream[spread(to[a:b], sizes[x])] = raw[spread(begins[x], sizes[x])]
        a = b
    return stream, at, at[last - n_words]


def slices(stream: np.ndarray, doc_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in stream and their keys, without the spaces before documents."""
    spelt = np.ones(len(stream), bool)
    for k in range(1, ORDER + 1):
        spelt[doc_at - k] = False
    for a in range(ORDER, len(stream), SLICE):
        b = min(a + SLICE, len(stream))
        place = np.flatnonzero(spelt[a:b])
        yield place + a, keys_at(stream, a, b)[place]


def distinct(stream: np.ndarray, doc_at: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a stream in order, and how often each is in documents that are learned from."""
    learned = np.repeat(train, np.diff(np.append(doc_at, len(stream) + ORDER)))  # of the places from the first document on
    bit = 8 * (ORDER + 1)
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for place, key in slices(stream, doc_at):  # one slice after another, so that only distinct keys are held
        more, more_n = np.unique(key | (learned[place - ORDER].astype(np.int64) << bit), return_counts=True)
        cut = int(np.searchsorted(more, 1 << bit))  # from there on, keys of documents that are learned from
        more_n[:cut] = 0
        for new, new_n in ((more[:cut], more_n[:cut]), (more[cut:] & ((1 << bit) - 1), more_n[cut:])):
            at = np.searchsorted(keys, new)
            known = at < len(keys)
            known[known] = keys[at[known]] == new[known]
            n[at[known]] += new_n[known]
            keys, n = (np.insert(x, at[~known], y[~known]) for x, y in ((keys, new), (n, new_n)))
    return keys, n


def _by_shard(rows: DataFrame, names: tuple[str, ...], flush, schema: str) -> DataFrame:
    """What flush makes of each shard's number and columns of rows (shard, *names)."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        common.hand_back()
        for batch in parts:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and shard != now:
                    yield flush(now, *zip(*held, strict=True))
                    held.clear()
                    common.hand_back()
                now = shard
                held.append(row)
        if held:
            yield flush(now, *zip(*held, strict=True))
            held.clear()
            common.hand_back()

    return rows.sortWithinPartitions("shard").select("shard", *names).mapInArrow(gather, schema)


def shards(rows: DataFrame) -> DataFrame:
    """Rows (shard, block, text, size, n) of words as (of_block, shard, count): the training counts of each block's words; all, known:
    those of the shard added up, and its distinct words that have one."""

    def flush(shard, block, text, size, n) -> pa.RecordBatch:
        sizes = [_array(x, "<u4") for x in size]
        coded = common.binary_array(np.concatenate([_array(x, "u1") for x in text]), np.concatenate(sizes)).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(at, np.concatenate([_array(x, "<u4") for x in n]), len(coded.dictionary)).astype(np.int64)
        tell = [_binary(counts[x].astype("<u4")) for x in np.split(at, np.cumsum([len(x) for x in sizes])[:-1])]
        all_, known = (np.zeros(len(block), np.int64) for _ in range(2))
        all_[0], known[0] = counts.sum(), (counts > 0).sum()
        return pa.record_batch([pa.array(block, pa.int64()), pa.array([shard] * len(block), pa.int32()), pa.array(tell, pa.binary()), pa.array(all_), pa.array(known)], ["of_block", "shard", "count", "all", "known"])

    return _by_shard(rows, ("block", "text", "size", "n"), flush, "of_block long, shard int, count binary, all long, known long")


GRAMS = "shard int, blocks array<long>, sizes array<int>, at binary, keys array<long>, sums array<long>"


def grams(rows: DataFrame) -> DataFrame:
    """One row per shard of rows (shard, block, key, n): its distinct pairs, their training counts, and which of them each block asked for."""

    def flush(shard, block, key, n) -> pa.RecordBatch:
        asked = [np.cumsum(_unturned(x, "<i8")) for x in key]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(at, np.concatenate([_unturned(x, "<u4") for x in n]), len(keys)).astype(np.int64)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = [pa.array([shard], pa.int32()), one(pa.array(block, pa.int64())), one(pa.array([len(x) for x in asked], pa.int32())), pa.array([_turned(np.diff(at, prepend=0).astype("<i4"))], pa.binary()), one(pa.array(keys)), one(pa.array(sums))]
        return pa.record_batch(row, [x.split()[0] for x in GRAMS.split(", ")])

    return _by_shard(rows, ("block", "key", "n"), flush, GRAMS)


# Trie -----------------------------------------------------------------------------------------------------------------


def code_lengths(deepest: DataFrame) -> DataFrame:
    """(key, lp): log10 probabilities of the keys of deepest (key, n), which also has keys with n = 0, by the model its counts make."""
    spark = deepest.sparkSession
    path = common.scratch(spark, "ppm-trie")
    low = lambda k: (1 << (8 * (k + 1))) - 1  # noqa: E731  the bits of a context of k bytes and the byte after it
    seen, levels = deepest.filter("n > 0").select("key", "n"), {}
    for k in range(ORDER, -1, -1):
        levels[k] = seen = common.settled(seen, f"{path}/level{k}")
        if k:
            seen = seen.groupBy(F.col("key").bitwiseAND(F.lit(low(k - 1))).alias("key")).agg(F.count("*").alias("n"))
    # How a level's nodes escape, and what is left of the next shorter context once a node's own bytes are excluded.
    asked, found = deepest.select("key").withColumn("lp", F.lit(0.0)).withColumn("out", F.lit(0).cast("long")), None
    for k in range(ORDER, -1, -1):
        level = levels[k]
        c = level.agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("n2")).collect()[0]
        n1, n2 = c["n1"] or 0, c["n2"] or 0
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
        nodes = level.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if k:
            below = levels[k - 1].withColumnRenamed("key", "short").withColumnRenamed("n", "m")
            inner = level.withColumn("short", F.col("key").bitwiseAND(F.lit(low(k - 1)))).join(below, "short").groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("m").alias("gone"), F.count("*").alias("gone_kinds"))
            nodes = nodes.join(inner, "ctx")
        else:
            nodes = nodes.withColumns({"gone": F.lit(0).cast("long"), "gone_kinds": F.col("kinds")})
        nodes = common.settled(nodes, f"{path}/nodes{k}")
        asked = asked.withColumn("at", F.col("key").bitwiseAND(F.lit(low(k)))).withColumn("ctx", F.shiftright("at", 8))
        # A node whose context was never seen is passed by without an escape.
        x = asked.join(nodes, "ctx", "left").join(level.select(F.col("key").alias("at"), "n"), "at", "left")
        left = F.col("total") - F.col("out")  # of the node's counts, those that no longer context excludes
        has_left = F.col("total").isNotNull() & (left > 0)
        # With some of its bytes excluded, a node's discount still takes d from each of the others.
        kinds_left = F.col("kinds") - F.col("out_kinds") if k < ORDER else F.col("kinds")
        hit = has_left & F.col("n").isNotNull()
        x = x.withColumn("hit", F.coalesce(hit, F.lit(False)))
        got = x.filter("hit").select("key", (F.col("lp") + F.log10((F.col("n") - F.lit(d)) / left)).alias("lp"))
        found = got if found is None else found.unionByName(got)
        escape = F.when(has_left, F.log10(F.lit(d) * kinds_left / left)).otherwise(0.0)
        rest = x.filter(~F.col("hit")).select("key", (F.col("lp") + escape).alias("lp"), F.coalesce("gone", F.lit(0).cast("long")).alias("out"), F.coalesce("gone_kinds", F.lit(0).cast("long")).alias("out_kinds"))
        asked = common.settled(rest, f"{path}/asked{k}")
    seen0 = levels[0].count()
    last = asked.select("key", (F.col("lp") - math.log10(max(1, SYMBOLS - seen0))).alias("lp"))
    return found.unionByName(last)


# Segments -------------------------------------------------------------------------------------------------------------


COUNTED = "of_block long, shard int, n binary, ones long, twos long, firsts long, adds array<struct<shard:int,before:binary,total:binary,kinds:binary>>"


def counted(events: DataFrame, n_shards: int) -> DataFrame:
    """COUNTED of events (shard, block, before, segment, train): the training counts of each event's pair; and of each shard in its first
    row, ones, twos: pairs that were seen so often, firsts: distinct pairs that begin documents, and adds: by the shard of the
    segment before, what its pairs add up to and how many they are."""

    def flush(shard, block, before, own, train) -> pa.RecordBatch:
        before, own, train = ([_array(x, t) for x in y] for y, t in ((before, "<u8"), (own, "<u8"), (train, "u1")))
        sizes = np.array([len(x) for x in train])
        before, own, train = (np.concatenate(x) for x in (before, own, train))
        order = np.lexsort((own, before))
        b, o = before[order], own[order]
        new_b = np.concatenate([[True], b[1:] != b[:-1]])
        new = new_b | np.concatenate([[True], o[1:] != o[:-1]])
        pair, node = np.cumsum(new) - 1, np.cumsum(new_b) - 1
        n = np.bincount(pair, train[order])
        total, kinds = np.bincount(node, train[order]), np.bincount(node[new], n > 0)
        out = np.zeros(len(order), np.uint32)
        out[order] = n[pair]
        cut = np.cumsum(sizes) - sizes
        tell = [_binary(out[a : a + m]) for a, m in zip(cut, sizes, strict=True)]
        ones, twos, firsts = (np.zeros(len(block), np.int64) for _ in range(3))
        ones[0], twos[0], firsts[0] = (n == 1).sum(), (n == 2).sum(), ((n > 0) & (b[new] == START_HASH)).sum()
        known = total > 0
        segment, total, kinds = b[new_b][known], total[known], kinds[known]
        adds = [{"shard": k, "before": _binary(segment[x]), "total": _binary(total[x].astype("<u4")), "kinds": _binary(kinds[x].astype("<u4"))} for k, x in dealt(segment, n_shards)]
        kind = pa.struct([("shard", pa.int32()), *((x, pa.binary()) for x in ("before", "total", "kinds"))])
        return pa.record_batch([pa.array(block), pa.array([shard] * len(block), pa.int32()), pa.array(tell, pa.binary()), pa.array(ones), pa.array(twos), pa.array(firsts), pa.array([adds, *[None] * (len(block) - 1)], pa.list_(kind))], [x.split()[0] for x in COUNTED.split(", ")])

    return _by_shard(events, ("block", "before", "segment", "train"), flush, COUNTED)


def added(rows: DataFrame) -> DataFrame:
    """(of_block, before_shard, total, kinds) for rows (shard, block, before, total, kinds): without a block, what a shard of pairs adds to segments;
    with one, the segments that it asks for."""

    def flush(shard, block, before, total, kinds) -> pa.RecordBatch:
        asked = [(x, _array(y, "<u8")) for x, y in zip(block, before, strict=True) if x is not None]
        given = [k for k, x in enumerate(block) if x is None]
        key, at = np.unique(np.concatenate([np.zeros(0, "<u8"), *(_array(before[k], "<u8") for k in given)]), return_inverse=True)
        sums = [np.append(np.bincount(at, np.concatenate([np.zeros(0, "<u4"), *(_array(x[k], "<u4") for k in given)]), len(key)), 0) for x in (total, kinds)]
        tell = []
        for _, x in asked:
            place = np.searchsorted(key, x)
            place[(place == len(key)) | (key[np.minimum(place, max(0, len(key) - 1))] != x if len(key) else True)] = len(key)
            tell.append([_binary(y[place].astype("<u8")) for y in sums])
        return pa.record_batch([pa.array([x for x, _ in asked], pa.int64()), pa.array([shard] * len(asked), pa.int32()), *(pa.array([x[k] for x in tell], pa.binary()) for k in (0, 1))], ["of_block", "before_shard", "total", "kinds"])

    return _by_shard(rows, ("block", "before", "total", "kinds"), flush, "of_block long, before_shard int, total binary, kinds binary")


# Documents ------------------------------------------------------------------------------------------------------------

COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def to_score(made: DataFrame) -> DataFrame:
    """What scoring needs of blocks, by field, so that no others are read: hashes that were counted long ago are half of a block."""
    some = lambda rows, *names: F.arrays_zip(*(F.col(f"{rows}.{x}") for x in ("shard", *names)))
    return made.select("block", "doc_id", "held_out", "n_tokens", "codes", "segments", "n_segments", some("words", "code", "text", "size").alias("words"), some("events", "at").alias("event_at"), some("befores", "at").alias("before_at"), "before_of")


def score(docs: DataFrame, modulus: int = 10, held_out: int = 0) -> DataFrame:
    """COLUMNS, one row per row of docs. Documents whose id's remainder is held_out are not learned from."""
    spark = docs.sparkSession
    path = common.scratch(spark, "ppm")
    # Shards follow the input's size; a shard's words and events are an even share of all blocks'.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.texts(docs).rdd.getNumPartitions())
    n_words = max(2, n // PARTITIONS_A_SHARD)
    made = common.settled(blocks(docs, modulus, held_out, n_words, n), f"{path}/blocks", compression="uncompressed")
    events = made.select("block", F.explode("events").alias("e")).select("block", "e.shard", "e.before", "e.segment", "e.train").repartitionById(n, F.col("shard"))
    seen = common.settled(counted(events, n), f"{path}/segments", compression="zstd")
    none = F.lit(None).cast("binary")
    adds = seen.select(F.explode("adds").alias("a")).select("a.shard", F.lit(None).cast("long").alias("block"), "a.before", "a.total", "a.kinds")
    asks = made.select("block", F.explode("befores").alias("b")).select("b.shard", "block", "b.before", none.alias("total"), none.alias("kinds"))
    sums = common.settled(added(adds.unionByName(asks).repartitionById(n, F.col("shard"))), f"{path}/sums", compression="zstd")
    often = seen.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos"), F.sum("firsts").alias("firsts")).collect()[0]
    discount = min(0.95, max(0.1, often["ones"] / (often["ones"] + 2 * often["twos"]))) if often["ones"] else 0.1
    first_kinds = often["firsts"] or 0
    ends = made.agg(F.sum(F.aggregate("held_out", F.lit(0).cast("long"), lambda a, x: a + F.when(x, 0).otherwise(1))).alias("ends")).collect()[0]["ends"] or 0
    words = made.select("block", F.explode("words").alias("w")).select("block", "w.shard", "w.text", "w.size", "w.n").repartitionById(n_words, F.col("shard"))
    counts = common.settled(shards(words), f"{path}/shards", compression="zstd")
    asked = made.select("block", F.explode("pairs").alias("p")).select("block", "p.shard", "p.key", "p.n").repartitionById(n, F.col("shard"))
    held = common.settled(grams(asked), f"{path}/grams", compression="zstd")
    keyed = held.select("shard", F.posexplode(F.arrays_zip("keys", "sums")).alias("at", "x")).select("shard", "at", F.col("x.keys").alias("key"), F.col("x.sums").alias("n"))
    # Pairs were dealt out by themselves, so that none is in two shards.
    deepest = common.settled(keyed.select("key", "n"), f"{path}/pairs")
    lengths = common.settled(code_lengths(deepest), f"{path}/lengths")
    totals = counts.agg(F.sum("all").alias("n"), F.sum("known").alias("v")).collect()[0]
    total, kinds = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    base = lambda c: np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))

    priced = keyed.join(lengths, "key").select(F.col("shard").alias("of"), "at", "lp")

    def price(left: pa.Table, right: pa.Table) -> pa.Table:
        common.hand_back()
        blocks_, sizes, keys = (left.column(x).combine_chunks()[0].values for x in ("blocks", "sizes", "keys"))
        lp = np.zeros(len(keys), "<f4")
        lp[right.column("at").to_numpy()] = right.column("lp").to_numpy()
        at = np.split(np.cumsum(_unturned(left.column("at")[0].as_py(), "<i4")), np.cumsum(sizes.to_numpy(zero_copy_only=False))[:-1])
        shard = left.column("shard")[0].as_py()
        return pa.table([blocks_, pa.array([shard] * len(at), pa.int32()), pa.array([_turned(lp[x]) for x in at], pa.binary())], ["of_block", "shard", "lp"])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        common.hand_back()
        codes = _array(left.column("codes")[0].as_py(), "<u4")
        ids, out, n_tokens, words, event_at, before_at = (left.column(x).combine_chunks()[0].values for x in ("doc_id", "held_out", "n_tokens", "words", "event_at", "before_at"))
        words = {x["shard"]: [_array(x[y], z) for y, z in (("code", "<u4"), ("text", "u1"), ("size", "<u4"))] for x in words.to_pylist()}
        event_at, before_at = ({x["shard"]: _array(x["at"], "<u4") for x in y.to_pylist()} for y in (event_at, before_at))
        n_tokens = n_tokens.to_numpy(zero_copy_only=False)
        # The words again, in the shards' order, and the documents spelt with them.
        order, raw, size = (np.concatenate([np.zeros(0, z), *(x[k] for x in words.values())]) for k, z in enumerate(("<u4", "u1", "<u4")))
        word_begins, word_sizes = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        word_sizes[order] = size
        word_begins[order] = np.cumsum(size, dtype=np.int64) - size
        stream, token_at, doc_at = spelling(codes, n_tokens - 1, raw, word_begins, word_sizes)
        keys = distinct(stream, doc_at, np.zeros(len(ids), bool))[0]
        common.hand_back()
        pair_at = dict(dealt(common.mix64(keys), n))
        count, by_key = np.zeros(len(order), np.int64), np.zeros(len(keys), "<f4")
        for k, x, y in zip(*(right.column(x).to_pylist() for x in ("shard", "count", "lp")), strict=True):
            if x is not None:
                count[words[k][0]] = _array(x, "<u4")
            if y is not None:
                by_key[pair_at[k]] = _unturned(y, "<f4")
        # Tokens' code lengths by the bytes, end marks included, added up by segment.
        token = np.zeros(len(token_at))
        for place, key in slices(stream, doc_at):
            few, at = np.unique(key, return_inverse=True)  # looked up in order, which is faster
            lp = by_key[np.searchsorted(keys, few)][at]
            first, last = np.searchsorted(token_at, place[[0, -1]], "right") - 1
            begins = np.searchsorted(place, token_at[first + 1 : last + 1])
            token[first : last + 1] += np.add.reduceat(lp, np.concatenate([[0], begins]), dtype=float)
        del stream, token_at, keys, pair_at, by_key
        common.hand_back()
        sums, word_at = np.zeros((2, len(ids))), np.append(0, np.cumsum(n_tokens - 1))
        for a in range(0, len(codes), SLICE):
            x = codes[a : a + SLICE]
            doc = np.searchsorted(word_at, np.arange(a, a + len(x)), "right") - 1
            for k, y in enumerate((count > 0, base(count))):
                sums[k] += np.bincount(doc, y[x], len(ids))
        del codes
        sizes = _array(left.column("segments")[0].as_py(), "<u4").astype(np.int64)
        spelt = np.add.reduceat(token, np.cumsum(sizes) - sizes)
        before_of = _array(left.column("before_of")[0].as_py(), "<u4")
        often, all_n, kinds = (np.zeros(len(sizes)), *(np.zeros(int(before_of.max(initial=0)) + 1) for _ in range(2)))
        for k, x in zip(*(right.column(c).to_pylist() for c in ("shard", "n")), strict=True):
            if x is not None:
                often[event_at[k]] = _array(x, "<u4")
        for k, x, y in zip(*(right.column(c).to_pylist() for c in ("before_shard", "total", "kinds")), strict=True):
            if x is not None:
                all_n[before_at[k]], kinds[before_at[k]] = _array(x, "<u8"), _array(y, "<u8")
        all_n, kinds = all_n[before_of], kinds[before_of]
        in_doc = left.column("n_segments").combine_chunks()[0].values.to_numpy(zero_copy_only=False)
        begins = np.cumsum(in_doc) - in_doc
        all_n[begins], kinds[begins] = ends, first_kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = np.log10((often - discount) / all_n)
            escape = np.where(all_n > 0, np.log10(discount * kinds / all_n), 0.0)
        each = np.where(often > 0, whole, escape + spelt)
        by_doc = np.repeat(np.arange(len(ids)), in_doc)
        return pa.table([ids, out, pa.array(n_tokens), pa.array(sums[0].astype(np.int64) + (ends > 0)), pa.array(np.full(len(ids), total)), pa.array(sums[1] + base(ends)), pa.array(np.bincount(by_doc, each, len(ids)))], [x.split()[0] for x in COLUMNS.split(", ")])

    told = held.groupBy("shard").cogroup(priced.groupBy("of")).applyInArrow(price, "of_block long, shard int, lp binary")
    for more in (counts.drop("all", "known"), seen.select("of_block", "shard", "n"), sums):
        told = told.unionByName(more, allowMissingColumns=True)
    own = to_score(made)
    return own.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(add, COLUMNS)
