import hashlib
import random

from pyspark.sql import functions as F

from loomgraph.llm import prefix_hash as ph

from .data import no_docs, odd_docs, odd_rows


def test_spans_and_extensions():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(2))
        p, q = ph.Prefixes(ph.points(a)), ph.Prefixes(ph.points(b))
        for _ in range(20):
            i, j, n = rng.randint(0, len(a)), rng.randint(0, len(b)), rng.randint(0, 10)
            inside = i + n <= len(a) and j + n <= len(b)
            assert p.equal(i, q, j, n) == (inside and a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert p.extension(i, q, j) == k


def slow(rows):
    import xxhash

    tie = lambda t: (x := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64 if x >> 63 else 0)
    ordered = sorted(((-1 if d is None else d, tie(t), t or "") for d, t, *_ in rows), reverse=True)
    out = []
    for k, (doc, _, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][2]
        half = len(text) // 2
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out)


def test_edited_texts(spark):
    got = ph.compare_to_next(odd_docs(spark)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == slow(odd_rows())
    texts = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
        texts.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    copies = {r.fingerprint for r in got if r.doc_id is not None and 100 <= r.doc_id < 120}
    assert len(copies) == 1


def test_likeness():
    a = "the quick brown fox jumps over the lazy dog and runs away from it all. " * 8
    fp = lambda t: ph.parse(ph.fingerprint(p := ph.Prefixes(ph.points(t)), ph.sketch(p)))
    rng = random.Random(2)
    b, c = ("".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(2))
    half = b[:1000] + c[:1000]
    assert ph.likeness(fp(a), fp(a)) == 1 and ph.likeness(fp(b), fp(c)) < 0.05
    assert 0.35 < ph.likeness(fp(b), fp(half)) < 0.65
    assert ph.likeness(fp(""), fp("")) == 1 and ph.likeness(fp(""), fp("x")) == 0


def test_few_documents(spark):
    assert ph.compare_to_next(no_docs(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    (row,) = ph.compare_to_next(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert ph.compare_to_next(many.repartition(5)).count() == 500


def exact(a, b):
    """Dice's coefficient of the spans themselves, of the shorter text's own size."""
    size = min(ph.sizes(len(x))[0] for x in (a, b))
    x, y = ({t[k : k + size] for k in range(len(t) - size + 1)} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_likeness_follows_the_spans_across_all_lengths():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(700))
    fp = lambda t: ph.parse(ph.fingerprint(p := ph.Prefixes(ph.points(t)), ph.sketch(p)))
    for n in [*range(1, 140), 255, 256, 257, 300, 600]:
        for m in (n + 1, n + n // 3, 2 * n):
            a, b = text[:n], text[:m]
            if n >= 4 and m <= 700:
                assert abs(ph.likeness(fp(a), fp(b)) - exact(a, b)) < 0.25, (n, m)
                assert ph.likeness(fp(a), fp(b)) == ph.likeness(fp(b), fp(a)) > 0
    for n in (8, 16, 32, 64, 128, 256):
        assert ph.likeness(fp(text[: n - 1]), fp(text[:n])) > 0.6


def test_long_texts_are_worked_through_in_slices():
    rng = random.Random(8)
    text = "".join(rng.choice("abü\U0001f600") for _ in range(3 * ph.SLICE + 17))
    p = ph.Prefixes(ph.points(text))
    for k, (prime, base) in enumerate(zip(ph.PRIMES, ph.BASES, strict=True)):
        h = 0
        for j, c in enumerate(text):
            h = (h + (ord(c) + 1) * pow(base, j, prime)) % prime if j % 5000 == 0 or j >= len(text) - 3 else (h + (ord(c) + 1) * (power := power * base % prime)) % prime
            power = pow(base, j, prime) if j % 5000 == 0 or j >= len(text) - 3 else power
        assert int(p.h[k][-1]) == h
    near = ph.Prefixes(ph.points("x" * 7 + text))
    assert near.extension(7, p, 0) == len(text) and [x.tolist() for x in near.spans(16)][-1][-1] == [x.tolist() for x in p.spans(16)][-1][-1]
    assert all(len(x) == ph.SLICE for x in (*ph._POWERS, *ph._UNDO))
