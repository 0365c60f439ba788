import random

import numpy as np
import xxhash

from loomgraph.llm import simhash

from .data import by_python, no_docs, odd_docs, odd_rows


def slow(text):
    w = by_python(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def sets(fps, radius=4):
    label, before = list(range(len(fps))), None
    while label != before:
        before = list(label)
        for a, x in enumerate(fps):
            for b, y in enumerate(fps):
                if (x ^ y).bit_count() <= radius:
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_fingerprints():
    for _, text, *_ in odd_rows():
        assert simhash.fingerprint((text or "").encode()) & (1 << 64) - 1 == slow(text)


def test_groups(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    fps = [slow(t) for _, t, *_ in rows]
    label = sets(fps)
    least = {}
    for (doc, *_), s in zip(rows, label, strict=True):
        if doc is not None:
            least[s] = min(least.get(s, doc), doc)
    want = sorted((str(d), f"{f:016x}", str(least.get(s))) for (d, *_), f, s in zip(rows, fps, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_one_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    label = sets([slow(t) for _, t, *_ in odd_rows()])
    assert kept.count() == len(set(label))
    assert sorted(slow(r.text) for r in kept.collect()) == sorted(set(slow(r.text) for r in kept.collect()))


def test_no_documents(spark):
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    assert simhash.keep_one(no_docs(spark)).count() == 0


def planted(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
    out = set()
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_bit_sliced_comparison_equals_brute_force():
    for n, seed in ((3, 1), (70, 2), (400, 3)):
        fps = np.array(planted(n, seed), np.uint64)
        cut = sorted({0, len(fps) // 3, len(fps)})
        got = simhash.link(fps, np.array(cut), 4)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            want = np.arange(b - a)
            near = np.bitwise_count(fps[a:b, None] ^ fps[None, a:b]) <= 4
            i, j = np.nonzero(np.triu(near, 1))
            assert (got[a:b] - a == simhash.roots(b - a, i, j, want)).all()


def test_large_groups_are_dealt_out_again(spark):
    fps = [simhash.signed(x) for x in planted(600, 7)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    index = {x: k for k, x in enumerate(fps)}
    found = []
    for limit in (100_000, 3):
        edges = [(index[r.u], index[r.v]) for r in simhash.near_links(df, group_max=limit).collect()]
        a, b = np.array(edges).T
        found.append(simhash.roots(len(fps), a, b))
    u = np.array(fps).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    want = simhash.roots(len(fps), i, j)
    assert (found[0] == want).all() and (found[1] == want).all()


def test_blocks_lose_no_pair():
    rng = random.Random(2)
    for n in (10, 10**5, 10**7, 10**9):
        masks = simhash.masks(n, (1 << 64) - 1, 4)
        for _ in range(200):
            x = 0
            for b in rng.sample(range(64), 4):
                x |= 1 << b
            assert any(m & x == 0 for m in masks)


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    rows = [(5, "one two three four five six", f"s{k % 7}", k % 3) for k in range(40)] + [(k, "one two three four five six seven", "t", k) for k in range(5, 12)] + [(None, "other words wholly", "u", 1), (None, "other words wholly", "v", 1)]
    schema = "doc_id long, text string, own_fp string, own_row int"
    kept = [sorted(map(str, simhash.keep_one(spark.createDataFrame(x, schema).repartition(n)).collect())) for x, n in ((rows, 1), (rows[::-1], 3), (rows[20:] + rows[:20], 5))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3
