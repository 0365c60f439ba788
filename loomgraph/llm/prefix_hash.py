"""Document fingerprints from prefix polynomial hashes.

For code points c[0..n) and a base b modulo a prime p, H[i] is the sum of c[j] * b^j over j < i. Two spans are equal when
their differences of H, brought to a common power of b, are (but for a chance below length / p for each of two primes).
From the same arrays follow the hash of any span in constant time, the equality of any two spans, and the longest common
extension of two places by binary search.

A fingerprint is `<code points>:<hash of the whole>:<sketches>`. A sketch has LANES numbers: the spans of one size at all
places fall into LANES by their hashes, and a lane holds the last 16 bits of the least hash it got. A text has a sketch of
spans of WINDOW code points, or, under 4 * WINDOW code points, of the largest power of two that is a quarter of it or less; texts under
16 * WINDOW have sketches of all smaller powers of two as well. Two texts are compared by the largest size that both have, which is the
own size of the shorter one; a text under 4 * WINDOW and one of 16 * WINDOW or more, over four times as long, have none.
The likeness of two fingerprints is 1 for equal wholes, else Dice's coefficient of their spans as the lanes estimate it:
with a share s of equal lanes among those that either has, 2s / (1 + s); 0 without a common size.

Null text is empty; an empty text's fingerprint has no lane, and its likeness to a text that is not empty is 0. Rows with repeated or null
ids follow each other in a fixed order (see compare_to_next); an empty table gives no rows. Only the id and the text are
read, so other columns may have any name. Texts are worked through in slices of SLICE code points: a worker holds some 30 bytes a
code point of the two texts that it compares, and no table that grows with texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The two largest primes below 2^31, and bases. Products of two remainders fit 62 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WINDOW = 16
LANES = 128
NONE = 0xFFFF

#: Code points that are looked at together.
SLICE = 1 << 15


def _table(base: int, p: int) -> np.ndarray:
    """base^0 to base^(SLICE - 1) modulo p."""
    got = np.ones(1, np.uint64)
    while len(got) < SLICE:
        got = np.concatenate([got, got * np.uint64(pow(base, len(got), p)) % np.uint64(p)])
    return got


#: The bases' inverses, and powers of both within a slice.
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True))
_POWERS = [_table(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
_UNDO = [_table(b, p) for b, p in zip(INVERSES, PRIMES, strict=True)]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefixes:
    """Prefix arrays of a text."""

    def __init__(self, c: np.ndarray, primes: int = 2):
        self.n = len(c)
        self.h = []
        for k in range(primes):
            p = np.uint64(PRIMES[k])
            sums = np.zeros(self.n + 1, np.uint64)
            for a in range(0, self.n, SLICE):
                b = min(a + SLICE, self.n)
                part = (c[a:b] + np.uint64(1)) * _POWERS[k][: b - a] % p * np.uint64(pow(BASES[k], a, PRIMES[k])) % p
                sums[a + 1 : b + 1] = (sums[a] + np.cumsum(part)) % p
            self.h.append(sums)

    def spans(self, size: int, k: int = 0) -> Iterator[np.ndarray]:
        """Hashes of all spans of size code points from the beginning on, slice by slice, brought to power zero."""
        p, h = np.uint64(PRIMES[k]), self.h[k]
        for a in range(0, self.n - size + 1, SLICE):
            b = min(a + SLICE, self.n - size + 1)
            yield (h[a + size : b + size] + p - h[a:b]) % p * _UNDO[k][: b - a] % p * np.uint64(pow(INVERSES[k], a, PRIMES[k])) % p

    def span(self, begin: int, end: int) -> tuple[int, ...]:
        """The hashes of one span, brought to power zero."""
        return tuple((int(h[end]) - int(h[begin])) * pow(INVERSES[k], begin, PRIMES[k]) % PRIMES[k] for k, h in enumerate(self.h))

    def equal(self, begin: int, other: Prefixes, other_begin: int, size: int) -> bool:
        """Whether size code points from begin on are those of other from other_begin on."""
        if begin + size > self.n or other_begin + size > other.n:
            return False
        return self.span(begin, begin + size) == other.span(other_begin, other_begin + size)

    def extension(self, begin: int, other: Prefixes, other_begin: int) -> int:
        """The length of the longest common extension from two places."""
        low, high = 0, min(self.n - begin, other.n - other_begin)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(begin, other, other_begin, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def whole(self) -> int:
        first, second = (int(h[-1]) for h in self.h)
        return first << 31 | second


def sizes(n: int) -> list[int]:
    """The span sizes, descending, of which a text of n code points has sketches."""
    own = min(WINDOW, 1 << max(0, (n // 4).bit_length() - 1))
    return [] if n == 0 else [own] if n >= 16 * WINDOW else [1 << k for k in range(own.bit_length() - 1, -1, -1)]


def sketch(prefixes: Prefixes) -> np.ndarray:
    """For each of sizes(), by lane the last 16 bits of the least span hash, or NONE."""
    out = np.full((len(sizes(prefixes.n)), LANES), 0xFFFFFFFF, np.uint32)
    for row, size in zip(out, sizes(prefixes.n), strict=True):
        for spans in prefixes.spans(size):
            mixed = common.mix64(spans + np.uint64(size << 40))
            np.minimum.at(row, (mixed & np.uint64(LANES - 1)).astype(np.intp), (mixed >> np.uint64(32)).astype(np.uint32))
    return np.where(out == 0xFFFFFFFF, NONE, np.minimum(out & np.uint32(0xFFFF), NONE - 1)).astype(np.uint16)


def fingerprint(prefixes: Prefixes, lanes: np.ndarray) -> str:
    return f"{prefixes.n:x}:{prefixes.whole():016x}:{lanes.astype('>u2').tobytes().hex()}"


def parse(printed: str) -> tuple[int, int, np.ndarray]:
    n, whole, lanes = printed.split(":")
    return int(n, 16), int(whole, 16), np.frombuffer(bytes.fromhex(lanes), ">u2").astype(np.uint16).reshape(-1, LANES)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    if a[:2] == b[:2]:
        return 1.0
    both = [x for x in sizes(a[0]) if x in sizes(b[0])]
    if not both:
        return 0.0
    x, y = (z[2][sizes(z[0]).index(both[0])] for z in (a, b))
    either = (x != NONE) | (y != NONE)
    share = ((x == y) & either).sum() / either.sum()
    return float(2 * share / (1 + share))


def edited(c: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Code points whose last half, rounded down, is replaced by as many first ones of those that follow, or all."""
    half = len(c) // 2
    return np.concatenate([c[: len(c) - half], following[:half]])


#: Rows sampled for each range.
SAMPLED = 60
_NONE = -(1 << 63)
ROWS = "part int, kind int, doc_id long, tie long, text string"
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """ROWS in as many partitions as there are ranges, sorted by (kind, doc_id, tie), the last two descending.

    Ranges are cut at sampled rows, so each range's first row is known: it also goes, as kind 1, to the range before
    (the very first row to the last range), where it is the document that follows the last one.
    """
    rows = common.texts(docs).withColumn("tie", F.xxhash64("text")).withColumn("_id", F.coalesce("doc_id", F.lit(_NONE)))
    stats = rows.agg(F.count("*").alias("n"), F.max(F.struct("_id", "tie")).alias("first")).collect()[0]
    if not stats["n"]:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("kind"), "doc_id", "tie", "text")
    first = (stats["first"]["_id"], stats["first"]["tie"])
    some = rows.filter(common.share_of(F.xxhash64("_id", "tie"), ranges * SAMPLED / stats["n"])).select("_id", "tie").limit(4 * ranges * SAMPLED).collect()
    places = sorted(((r["_id"], r["tie"]) for r in some), reverse=True)
    found = sorted({places[len(places) * k // ranges] for k in range(1, ranges)} - {first}, reverse=True) if places else []
    up = found[::-1]  # ascending, for bisect

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {x: k for k, x in enumerate(found, 1)} | {first: 0}
        for batch in common.batches(parts):
            keys = list(zip(common.column(batch, "_id").to_pylist(), common.column(batch, "tie").to_pylist(), strict=True))
            part = [len(up) - bisect_left(up, x) for x in keys]
            again = [k for k, x in enumerate(keys) if x in begins]
            take = pa.array([*range(len(keys)), *again], pa.int64())
            part += [(begins[keys[k]] - 1) % (len(up) + 1) for k in again]
            kind = [0] * len(keys) + [1] * len(again)
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *(common.column(batch, x).take(take) for x in ("doc_id", "tie", "text"))], ["part", "kind", "doc_id", "tie", "text"])

    dealt = rows.mapInArrow(deal, ROWS).repartitionById(len(up) + 1, F.col("part"))
    return dealt.sortWithinPartitions("part", "kind", F.desc_nulls_last("doc_id"), F.desc("tie"))


def compare_to_next(docs: DataFrame) -> DataFrame:
    """COLUMNS, one row per row of docs: fingerprints of each text and of its edited text, and their likenesses.

    The next document has the next smaller doc_id; rows that share one, or have none (these come last), follow each other in
    the order of their texts' hashes. After the last comes the first. kept_prefix is the longest common extension of
    a text and its edited text from their beginnings.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row(doc, c, prefixes, printed, parsed, following) -> tuple:
            other = edited(c, following[1])
            own = Prefixes(other)
            said = fingerprint(own, sketch(own))
            digest = hashlib.sha256(other.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
            return doc, len(c), digest, printed, said, likeness(parsed, parse(said)), likeness(parsed, following[4]), prefixes.extension(0, own, 0)

        for batch in common.batches(parts):
            out = []
            for kind, doc, text in zip(common.column(batch, "kind").to_pylist(), common.column(batch, "doc_id").to_pylist(), common.column(batch, "text").to_pylist(), strict=True):
                if kind == 1 and held is None:
                    continue
                c = points(text)
                prefixes = Prefixes(c)
                printed = fingerprint(prefixes, sketch(prefixes))
                now = (doc, c, prefixes, printed, parse(printed))
                if held is not None:
                    out.append(row(*held, now))
                held = now if kind == 0 else None
            if out:
                i, s, d = pa.int64(), pa.string(), pa.float64()
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (i, i, s, s, s, d, d, i), strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return in_order(docs, ranges).mapInArrow(each, COLUMNS)
