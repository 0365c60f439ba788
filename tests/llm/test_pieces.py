import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa

from loomgraph.llm import pieces as op

from .data import no_docs, odd_docs, odd_rows


def segmentations(word, known):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            for rest in segmentations(word[n:], known):
                yield known[word[:n]], *rest


def test_samples_follow_the_lattice():
    model = op.pieces(op.default_model())
    byte_ids = set(model.byte_id.tolist())
    content = [bytes(model.content[b : b + n]) for b, n in zip(model.begin, model.size, strict=True)]
    known = {c: k for k, c in enumerate(content) if c and k not in byte_ids}
    weight = {s: math.exp(sum(model.weight[k] for k in s)) for s in segmentations(b" there", known)}
    n = 20_000
    ids, counts = model.sample(pa.array([" there"] * n), np.arange(n).astype(np.uint64))
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends, strict=True))
    total = sum(weight.values())
    assert set(got) <= set(weight)
    for s, w in weight.items():
        assert abs(got[s] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-3


def test_rows_do_not_depend_on_the_batch():
    model = op.pieces(op.default_model())
    texts, keys = ["the thing there", "", "日本 ▁ü\n\n the", "x" * 300], np.array([7, 8, 9, 10], np.uint64)
    ids, counts = model.sample(pa.array(texts), keys)
    ends = np.cumsum(counts)
    for k, text in enumerate(texts):
        alone, _ = model.sample(pa.array([text]), keys[k : k + 1])
        assert alone.tolist() == ids[ends[k] - counts[k] : ends[k]].tolist()
    other, _ = model.sample(pa.array(texts), keys + np.uint64(1))
    assert other.tolist() != ids.tolist()


def test_round_trips(spark):
    got = op.round_trips(odd_docs(spark)).collect()
    assert all(r.lossless for r in got)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd_rows())
    assert [r.ids_crc32 for r in sorted(got, key=str)] == [r.ids_crc32 for r in sorted(op.round_trips(odd_docs(spark).repartition(1)).collect(), key=str)]


def test_encode_and_decode(spark):
    rows = op.encode(odd_docs(spark))
    assert sorted(r.text for r in op.decode(rows).collect()) == sorted(t or "" for _, t, *_ in odd_rows())
    assert op.decode(op.encode(no_docs(spark))).count() == 0
    assert op.round_trips(no_docs(spark)).count() == 0


def test_shares_are_those_of_the_chunk_alone():
    model = op.pieces(op.default_model())
    rng = np.random.default_rng(5)
    others = [bytes(rng.choice(np.frombuffer(b"etaoinshr", np.uint8), 6)) for _ in range(100_000)]
    mine = [b" therefore", "日本ü".encode(), b" nationalization"]
    raw = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.cumsum([0, *map(len, xs)]))
    begin, piece, share, first = model.lattice(*raw(mine))
    n = len(first) - 1
    b2, p2, s2, f2 = model.lattice(*raw([*others, *mine]))
    a, shift = f2[-1 - n], len(f2) - 1 - n
    assert (s2[a:] == share).all() and (p2[a:] == piece).all() and (b2[a:] - shift == begin).all()
    last = first[1:][np.diff(first) > 0] - 1
    assert np.allclose(share[last], 1)
