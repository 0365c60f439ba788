"""SimHash near-duplicates, compared bit-sliced.

1. A text's fingerprint has 64 bits: bit b is 1 where over half its shingles' XXH64 values have it.
2. Equal fingerprints become one, with their smallest doc_id; (doc_id, fingerprint) rows are written to the shared folder.
3. Candidates: the 64 bits fall into m blocks. Two fingerprints at most `radius` bits apart agree on m - radius whole
   blocks at least, so one of the C(m, radius) tables keyed by m - radius blocks brings them together: no pair is lost.
   m grows with the number of distinct fingerprints, which keeps the keys' bits above its logarithm.
4. Groups with equal keys are compared bit-sliced: each block of 64 fingerprints is stored as 64 bit planes, one word a
   plane; a query's differing bits are added to 64 counters at once by carry-save adders, and a (query, block) item is
   abandoned once all its counters exceed the radius. Only edges that join two so far separate sets leave a group.
   Groups above GROUP_MAX are dealt out again on blocks of their remaining bits, in other tasks, before they are compared.
5. Components by star contraction over the edges; the smallest doc_id of each goes back to its documents.

Null text is empty. An empty text (no words) has fingerprint zero, linked like any other. Rows that share a doc_id, or have a null
one, are rows of their own; null is never a component's id unless all its rows' ids are null. Only the id and the text are read,
so other columns may have any name. An empty table gives no rows. A worker holds some 30 bytes a byte of a batch's longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints with one key that a task compares; larger groups are dealt out again.
GROUP_MAX = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 bytes, as a signed 64-bit integer."""
    import xxhash

    spans = text.lower().split()
    if not spans:
        return 0
    joined = b" ".join(spans)
    ends = np.cumsum([len(x) + 1 for x in spans]) - 1
    n = max(1, len(spans) - shingle + 1)
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(spans)) - 1 :].tolist()
    one = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([one(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)]), np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # long texts in slices
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp)."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(parts):
            found = [fingerprint(x, shingle) for x in common.column(batch, "text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([common.column(batch, "doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return common.texts(docs).mapInArrow(each, "doc_id long, fp long")


def blocks(n: int, free: int, radius: int) -> list[list[int]]:
    """The free bits (a mask) in m blocks, so that m - radius of them have at least log2(n) bits between them."""
    bits = [b for b in range(64) if free >> b & 1]
    m = radius + 1
    while m < min(len(bits), 2 * radius + 2) and len(bits) * (m - radius) / m < np.log2(max(n, 2)):
        m += 1
    return [bits[len(bits) * k // m : len(bits) * (k + 1) // m] for k in range(m)]


def masks(n: int, free: int, radius: int) -> list[int]:
    parts = [sum(1 << b for b in x) for x in blocks(n, free, radius)]
    return [sum(c) for c in combinations(parts, max(1, len(parts) - radius))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# Bit-sliced comparison ------------------------------------------------------------------------------------------------


def planes(fps: np.ndarray, group_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of 64 fingerprints within groups: planes[block, bit], each block's first row, and each block's number of rows."""
    sizes = np.diff(group_at)
    n = -(-sizes // 64)
    first = np.repeat(group_at[:-1] - 64 * (np.cumsum(n) - n), n) + 64 * np.arange(n.sum())
    rows = np.minimum(64, np.repeat(group_at[1:], n) - first)
    out = np.zeros((len(first), 64), np.uint64)
    for lane in range(64):
        has = np.flatnonzero(rows > lane)
        if not len(has):
            break
        values = fps[first[has] + lane]
        for bit in range(64):
            out[has, bit] |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(lane)
    return out, first, rows


def compare(query: np.ndarray, block: np.ndarray, lanes: np.ndarray, plane: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Items (query value, block) whose block has lanes within radius: their numbers, and a word with those lanes set.

    lanes: a word for each item with the lanes to compare. Counters saturate: `over` keeps the lanes that went past 7.
    """
    if radius > 6:
        raise ValueError("the counters have three bits")
    zero = np.zeros(len(query), np.uint64)
    item, c0, c1, c2, over = np.arange(len(query)), zero, zero.copy(), zero.copy(), ~lanes
    for bit in range(64):
        x = plane[block, bit] ^ (np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1)))
        carry = c0 & x
        c0 = c0 ^ x
        carry, c1 = c1 & carry, c1 ^ carry
        carry, c2 = c2 & carry, c2 ^ carry
        over |= carry
        if bit >= radius and (bit % 4 == 3 or bit == 63):
            bits = [c0, c1, c2]
            past, same = over, ~np.uint64(0)
            for k in (2, 1, 0):  # past: counter > radius, compared from the highest bit
                if radius >> k & 1:
                    same = same & bits[k]
                else:
                    past = past | (same & bits[k])
                    same = same & ~bits[k]
            live = ~past != 0
            if bit == 63:
                return item[live], ~past[live]
            if not live.all():
                item, query, block, c0, c1, c2, over = (a[live] for a in (item, query, block, c0, c1, c2, over))
            if not len(item):
                break
    return item, np.zeros(0, np.uint64)


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 over edges a-b, on top of label."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while (label != (up := label[label])).any():
            label = up


#: Items of one call of compare().
ITEMS = 1 << 18


def link(fps: np.ndarray, group_at: np.ndarray, radius: int) -> np.ndarray:
    """For fingerprints sorted by group (rows group_at[g] to group_at[g + 1]): the first row of each one's set in its group."""
    n = len(fps)
    label = np.arange(n)
    plane, first, rows = planes(fps, group_at)
    block_at = np.searchsorted(first, group_at)  # the blocks of group g: block_at[g] to block_at[g + 1]
    group_of = np.repeat(np.arange(len(group_at) - 1), np.diff(group_at))
    own = np.searchsorted(first, np.arange(n), "right") - 1
    each = block_at[group_of + 1] - own  # blocks from a row's own to its group's last
    ends = np.cumsum(each)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, "right")))
        q = np.repeat(np.arange(at, stop), each[at:stop])
        k = own[q] + np.arange(len(q)) - np.repeat(ends[at:stop] - each[at:stop] - (ends[at - 1] if at else 0), each[at:stop])
        lanes = np.where(rows[k] == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(rows[k], 63).astype(np.uint64)) - np.uint64(1))
        after = (q - first[k] + 1).clip(0, 64)  # in a row's own block, only later rows
        lanes = np.where(own[q] == k, np.where(after >= 64, np.uint64(0), lanes & (~np.uint64(0) << np.minimum(after, 63).astype(np.uint64))), lanes)
        if at:  # blocks that are one set with the query already need no comparison
            low = np.minimum.reduceat(label, first)
            high = np.maximum.reduceat(label, first)
            lanes = np.where((low[k] == high[k]) & (low[k] == label[q]), np.uint64(0), lanes)
        todo = np.flatnonzero(lanes)
        hit, found = compare(fps[q[todo]], k[todo], lanes[todo], plane, radius)
        if len(hit):
            hit = todo[hit]
            for s in range(0, len(hit), 1 << 15):
                set_bits = np.unpackbits(found[s : s + (1 << 15)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
                i, lane = np.nonzero(set_bits)
                i = hit[s + i]
                label = roots(n, q[i], first[k[i]] + lane, label)
        at = stop
    return label


# Spark ----------------------------------------------------------------------------------------------------------------


def tables(found: list[int]) -> Column:
    """(t, key) for each mask."""
    return F.array([F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(found)])


def keyed(fps: DataFrame, found: list[int]) -> DataFrame:
    """Rows (g, fp): fp is in group g, a table's number and the key's bits."""
    return fps.select(F.explode(tables(found)).alias("g"), "fp")


def keyed_again(rows: DataFrame, found: list[int], largest: int, radius: int) -> DataFrame:
    """Rows (g, fp) of groups of keyed(), dealt out by blocks of the bits that their keys leave free."""
    full = (1 << 64) - 1
    by_table = [tables(masks(largest, full & ~m, radius)) for m in found]
    choice = F.when(F.col("g.t") == 0, by_table[0])
    for t, x in enumerate(by_table[1:], 1):
        choice = choice.when(F.col("g.t") == t, x)
    return rows.select("g", F.explode(choice).alias("x"), "fp").select(F.struct("g", "x").alias("g"), "fp")


def links_of(groups: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between fingerprints within radius that share a group."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_g = [], []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            fp, g = np.concatenate(held_fp), np.concatenate(held_g)
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            stop = len(fp) if last else (int(cuts[-1]) if len(cuts) else 0)
            held_fp[:], held_g[:] = [fp[stop:]], [g[stop:]]
            if not stop:
                return
            at = np.concatenate([[0], cuts[cuts < stop], [stop]])
            many = np.diff(at) > 1
            if not many.any():
                return
            kept = np.repeat(many, np.diff(at))
            sub = fp[:stop][kept]
            label = link(sub.view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(at)[many])]), radius)
            joined = np.flatnonzero(label != np.arange(len(label)))
            if len(joined):
                yield pa.record_batch([pa.array(sub[joined]), pa.array(sub[label[joined]])], ["u", "v"])

        for batch in parts:
            held_fp.append(common.column(batch, "fp").to_numpy(zero_copy_only=False))
            held_g.append(common.column(batch, "h").to_numpy(zero_copy_only=False))
            if sum(map(len, held_fp)) >= 1 << 18:
                yield from flush(False)
        if held_fp:
            yield from flush(True)

    # Two groups whose hashes meet are compared as one, which finds true links only.
    hashed = groups.select("fp", F.xxhash64("g").alias("h"))
    return hashed.repartition("h").sortWithinPartitions("h").mapInArrow(each, "u long, v long")


def near_links(fps: DataFrame, radius: int = RADIUS, group_max: int = GROUP_MAX) -> DataFrame:
    """Edges whose components are those of all pairs of distinct fps (fp) within radius."""
    n = fps.count()
    found = masks(n, (1 << 64) - 1, radius)
    groups = keyed(fps, found)
    large = groups.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > group_max)
    largest = large.agg(F.max("n").alias("n")).collect()[0]["n"]
    if largest is None:
        return links_of(groups, radius)
    # After the second dealing so few bits are free that their number bounds a group.
    again = keyed_again(groups.join(large.select("g"), "g", "left_semi"), found, largest, radius)
    return links_of(groups.join(large.select("g"), "g", "left_anti"), radius).unionByName(links_of(again, radius))


def roots_of(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp, ...) with root, the least fingerprint that its own reaches."""
    sets = components(near_links(distinct.select("fp"), radius), "simhash-sets").withColumnRenamed("u", "fp")
    return distinct.join(sets, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs."""
    spark = docs.sparkSession
    path = common.scratch(spark, "simhash")
    marked = common.settled(fingerprints(docs, shingle), f"{path}/fingerprints")
    distinct = common.settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), f"{path}/distinct")
    rooted = roots_of(distinct, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = common.settled(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), f"{path}/components")
    # One fingerprint may be that of a great part of all rows.
    found = common.join_hot(marked, by_fp, common.hot_keys(distinct, "fp", marked.count()), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows that are broadcast at most, of one number each.
BROADCAST_ROWS = 1_000_000


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Of each component one row of docs stays, with all its columns: that of the smallest doc_id (null: the largest), then
    fingerprint, then content. Content orders rows by a hash of all columns, so the rows that stay don't depend on the order of rows."""
    spark = docs.sparkSession
    path = common.scratch(spark, "simhash-kept")
    own, tie, row = (common.free_name(docs, x) for x in ("own_fp", "own_tie", "own_row"))
    mark = common.scored(docs, lambda texts: np.array([fingerprint(x, shingle) for x in texts.cast(pa.binary()).to_pylist()], np.int64), kind="long")
    content = F.xxhash64(F.to_json(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])), docs["text"])
    # Written once, so that texts are read and fingerprinted once and a row's number stays its own.
    held = common.settled(docs.withColumns({own: mark, tie: content}).withColumn(row, F.monotonically_increasing_id()), f"{path}/rows", compression="zstd")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("fp"), F.col(tie).alias("tie"), F.col(row).alias("row"))).alias("first")
    distinct = common.settled(held.groupBy(F.col(own).alias("fp")).agg(first), f"{path}/distinct")
    stay = roots_of(distinct, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    stay = common.settled(stay, f"{path}/stay")
    # Rows' numbers are dealt out without texts; those that go are broadcast where they are few enough.
    gone = common.settled(held.select(row).join(stay, row, "left_anti"), f"{path}/gone")
    kept = held.join(F.broadcast(gone), row, "left_anti") if gone.count() <= BROADCAST_ROWS else held.join(stay, row, "left_semi")
    return kept.drop(own, tie, row)
