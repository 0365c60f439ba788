import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import common, ppm

from .data import by_python, no_docs, odd_docs, odd_rows


def test_base_score(spark):
    rows = odd_rows()
    got = ppm.score(odd_docs(spark)).collect()
    tokens = [[*by_python(t), "\n"] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows]
    c = Counter(w for x, h in zip(tokens, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for (d, *_), h, x in zip(rows, held, tokens, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    copies = {round(r.score, 9) for r in got if r.doc_id is not None and 100 <= r.doc_id < 120}
    assert len(copies) == 1


def lengths(spark, counts):
    deepest = spark.createDataFrame(counts, "key long, n long")
    return {r.key: r.lp for r in ppm.code_lengths(deepest).collect()}


def key(context, byte):
    padded = (b" " * ppm.ORDER + context)[-ppm.ORDER :] + bytes([byte])
    return int.from_bytes(padded, "big")


def test_probabilities_after_a_context_add_up_to_one(spark):
    words = ["abab", "abba", "ba", "b", "cab", "abab", "ab"]
    word, keys = ppm.pairs(pa.array([w.encode() for w in words], pa.binary()))
    counts = Counter(keys.tolist())
    contexts = [b"", b"a", b"ab", b"zz", b"abz"]
    asked = {key(c, b): 0 for c in contexts for b in range(256)}
    got = lengths(spark, [(k, counts.get(k, 0)) for k in sorted({*counts, *asked})])
    for c in contexts:
        assert abs(sum(10 ** got[key(c, b)] for b in range(256)) - 1) < 1e-9
    assert got[key(b"", ord("a"))] > got[key(b"", ord("c"))] > got[key(b"", ord("z"))]


def test_pairs():
    word, keys = ppm.pairs(pa.array([b"ab", b"c"], pa.binary()))
    assert word.tolist() == [0, 0, 0, 1, 1]
    assert keys.tolist() == [key(b"", ord("a")), key(b"a", ord("b")), key(b"ab", 32), key(b"", ord("c")), key(b"c", 32)]


def test_segments_begin_anew_with_each_document():
    token = ppm.word_hashes(pa.array([b"a", b"b", b"c", b"d", b"a", b"b"], pa.binary()))
    at, own, before, first = ppm.segments(token, np.array([0, 4]))
    assert 0 in at and 4 in at and before[0] == before[first[1]] == ppm.START_HASH
    alone = ppm.segments(token[4:], np.array([0]))
    assert alone[1].tolist() == own[first[1] :].tolist()


def test_copies_of_training_text_are_cheap(spark):
    text = " ".join(f"w{k}x{k * 7 % 11}" for k in range(200))
    rows = [(k, text if k % 2 else f"{k} " + " ".join(f"w{(j * k) % 97}" for j in range(150))) for k in range(60)]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = [r for r in got if r.held_out and r.doc_id % 2]
    assert copies and all(r.score > r.base_score / 4 for r in copies)


def test_no_documents(spark):
    assert ppm.score(no_docs(spark)).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [r.n_tokens for r in ppm.score(empty).collect()] == [1, 1]


def test_contexts_run_across_words(spark):
    """Held-out text whose words follow from the words before them, without copied segments."""
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(2)) for _ in range(150)]
    after = {w: rng.sample(words, 3) for w in words}

    def walk(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    rows = [(k, walk(120)) for k in range(300)]
    held = [(k, x) for k, x in rows if zlib.crc32(str(k).encode()) % 10 == 0]
    mixed = next(j for j in range(1000, 2000) if zlib.crc32(str(j).encode()) % 10 == 0)
    shuffled = rng.sample(held[0][1], 120)
    docs = [(k, " ".join(x)) for k, x in [*rows, (mixed, shuffled)]]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(held) > 5 and all(got[k].score > got[k].base_score / 2 for k, _ in held)
    assert got[mixed].n_known == got[held[0][0]].n_known and got[mixed].score < 1.5 * got[held[0][0]].score


def test_spelling():
    raw, begins, sizes = np.frombuffer(b"abcde", np.uint8), np.array([0, 2]), np.array([2, 3])
    stream, at, doc_at = ppm.spelling(np.array([1, 0]), np.array([2, 0]), raw, begins, sizes)
    pad = b" " * ppm.ORDER
    assert stream.tobytes() == pad + b"cde ab \n" + pad + b"\n"
    assert (at - ppm.ORDER).tolist() == [0, 4, 7, 8 + ppm.ORDER] and doc_at.tolist() == [at[0], at[3]]
    keys, n = ppm.distinct(stream, doc_at, np.array([True, False]))
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {key(b"", 10): 0, **{key(b"cde ab "[:k], (b"cde ab \n")[k]): 1 for k in range(8)}}


class Plain:
    """The model by dictionaries, one byte after another."""

    def __init__(self, texts, held):
        self.docs = [[*by_python(t), "\n"] for t in texts]
        self.held, train = held, [d for d, h in zip(self.docs, held, strict=True) if not h]
        deepest = Counter(x for d in train for x in self.grams(d))
        self.levels = {ppm.ORDER: deepest}
        for k in range(ppm.ORDER, 0, -1):
            self.levels[k - 1] = Counter(x[1:] for x in self.levels[k])
        self.nodes = {k: {} for k in self.levels}
        for k, level in self.levels.items():
            for x, n in level.items():
                self.nodes[k].setdefault(x[:-1], {})[x[-1]] = n
        self.discount = {k: self.rate(level.values(), 0.9) for k, level in self.levels.items()}
        self.pairs = Counter(x for d in train for x in self.segments(d)[0])
        self.segment_discount = self.rate(self.pairs.values(), 0.95)
        self.after = {}
        for (before, _), n in self.pairs.items():
            self.after.setdefault(before, []).append(n)

    @staticmethod
    def rate(counts, top):
        once, twice = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
        return min(top, max(0.1, once / (once + 2 * twice))) if once else 0.1

    @staticmethod
    def spelt(tokens):
        return b"".join(w.encode() + b" " for w in tokens[:-1]) + b"\n"

    def grams(self, tokens):
        raw = b" " * ppm.ORDER + self.spelt(tokens)
        return [raw[k : k + ppm.ORDER + 1] for k in range(len(raw) - ppm.ORDER)]

    @staticmethod
    def segments(tokens):
        hashes = np.append(ppm.word_hashes(pa.array([w.encode() for w in tokens[:-1]], pa.binary())), ppm.END_HASH)
        at, own, before, _ = ppm.segments(hashes, np.array([0]))
        return list(zip(before.tolist(), own.tolist(), strict=True)), at.tolist()

    def byte(self, gram):
        out, lp = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            node = self.nodes[k].get(gram[ppm.ORDER - k : -1])
            if node is None:
                out = set()
                continue
            left = {c: n for c, n in node.items() if c not in out}
            total, d = sum(left.values()), self.discount[k]
            if gram[-1] in left:
                return lp + math.log10((left[gram[-1]] - d) / total)
            if total:
                lp += math.log10(d * len(left) / total)
            out = set(node)
        return lp - math.log10(max(1, 256 - len(self.nodes[0].get(b"", {}))))

    def score(self, tokens):
        pairs, at = self.segments(tokens)
        sum_lp = 0.0
        for (before, own), a, b in zip(pairs, at, [*at[1:], len(tokens)], strict=True):
            counts, n = self.after.get(before, []), self.pairs[before, own]
            if n:
                sum_lp += math.log10((n - self.segment_discount) / sum(counts))
                continue
            if counts:
                sum_lp += math.log10(self.segment_discount * len(counts) / sum(counts))
            begin = len(self.spelt([*tokens[:a], "\n"])) - 1
            size = sum(len(w.encode()) + 1 for w in tokens[a:b]) - (b == len(tokens))  # the end mark is one byte
            sum_lp += sum(map(self.byte, self.grams(tokens)[begin : begin + size]))
        return sum_lp


def test_scores_are_those_of_a_plain_model(spark):
    rng = random.Random(9)
    phrase = " ".join(f"w{k}x{k * 7 % 11}" for k in range(60))
    texts = [" ".join(rng.choice(["the", "of", "stone", "river", "ü", "run"]) for _ in range(rng.randint(0, 40))) for _ in range(45)]
    texts += [phrase, phrase + " end", "on " + phrase, phrase, phrase[20:], ""] * 3
    rows = list(enumerate(texts))
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    plain = Plain(texts, held)
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(held) > 2
    for k, _ in rows:
        assert abs(got[k] - plain.score(plain.docs[k])) < 1e-4 * max(1, -got[k]), k


def peak(call):
    """Of the bytes that call holds at once, those that it does not return."""
    tracemalloc.start()
    try:
        out = call()
        held, most = tracemalloc.get_traced_memory()
        return out, most - held
    finally:
        tracemalloc.stop()


def test_segments_hold_little_more_than_their_tokens():
    token = common.mix64(np.random.default_rng(1).integers(0, 5000, 1_000_000).astype(np.uint64))
    begins = np.append(np.arange(0, 900_000, 300_000), 1_000_000 - 1)
    (at, own, before, first), most = peak(lambda: ppm.segments(token, begins))
    assert most < 2 * token.nbytes
    with np.errstate(over="ignore"):
        ended = common.mix64(token[1:] + token[:-1] * ppm._FACTOR) % np.uint64(ppm.SEGMENT) == 0
        assert at.tolist() == sorted({0, *(np.flatnonzero(ended[:-1]) + 2).tolist(), *begins.tolist()})
        for k in (0, 1, len(at) // 2, len(at) - 1):
            x = token[at[k] : at[k + 1] if k + 1 < len(at) else None]
            assert own[k] == common.mix64(common.mix64(x + np.arange(len(x)).astype(np.uint64) * ppm._FACTOR).sum(keepdims=True))[0]
    assert at[first].tolist() == begins.tolist() and (before[first] == ppm.START_HASH).all() and before[1] == own[0]


def test_distinct_keys_are_merged_without_sorting_them_again():
    stream = np.random.default_rng(2).integers(97, 123, 3 << 20).astype(np.uint8)
    stream[: ppm.ORDER] = 32
    (keys, n), most = peak(lambda: ppm.distinct(stream, np.array([ppm.ORDER]), np.array([True])))
    assert (np.diff(keys) > 0).all() and n.sum() == len(stream) - ppm.ORDER and most < 3 * (keys.nbytes + n.nbytes)


def test_workers_return_what_they_free():
    """Arrays that are freed between others that stay are not kept beside all that comes later."""
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    np.zeros(30 << 20, np.uint8).fill(1)  # glibc's threshold is raised to what was freed
    arrays = [np.ones(1 << 20, np.uint8) for _ in range(200)]
    arrays = arrays[::2]
    before = resident()
    common.hand_back()
    assert before - resident() > 50 << 20 and len(arrays) == 100


def test_scoring_reads_only_what_it_needs_of_blocks(spark, tmp_path):
    made = common.settled(spark.createDataFrame([], ppm.BLOCKS), f"{tmp_path}/blocks")
    scan = ppm.to_score(made)._jdf.queryExecution().sparkPlan().collectLeaves().head().requiredSchema().catalogString()
    assert "events:array<struct<shard:int,at:binary>>" in scan and "words:array<struct<shard:int,code:binary,text:binary,size:binary>>" in scan and "pairs" not in scan
