"""The impact walk where seeds are many: tasks hold the graph as numbers and walk their own seeds, so that no reached row is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut, fleeting

#: Steps that a walk holds in each Python worker, 8 bytes each; larger graphs are walked by joins.
HELD = 24_000_000
#: Steps that are looked at together, rows that are handed on together, starts that are walked from together at most, and starts a task.
SLICE, BATCH, TOGETHER, STARTS = 1 << 21, 1 << 17, 1 << 10, 1 << 14


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with its rows' places in the order: sorted in ranges, of which only the sizes meet on the driver."""
    held = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted(tuple(r) for r in held.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())
    before, pairs = start, []
    for p, n in sizes:
        pairs.append((p, before))
        before += n
    begins = held.sparkSession.createDataFrame(pairs or [(0, start)], "_p long, _before long")
    held = held.join(F.broadcast(begins), F.shiftright("_m", 33) == F.col("_p"))
    return held.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def _column(df: DataFrame, at: str, *names: str) -> list[pa.Array]:
    """Columns of df in the order of their numbers at."""
    got = df.select(at, *names).toArrow()
    order = pa.array(np.argsort(got.column(at).to_numpy(), kind="stable"))
    return [got.column(x).combine_chunks().take(order) for x in names]


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


class Graph:
    """Steps as numbers: those of node x are edges[begins[x]:begins[x + 1]], each a node and a label; label 0 is no step."""

    def __init__(self, begins: np.ndarray, edges: np.ndarray, label_bits: int, node_bits: int, carried: bool):
        self.begins, self.edges, self.lb, self.nb, self.carried = begins, edges, label_bits, node_bits, carried

    def levels(self, starts: np.ndarray, max_depth: int) -> Iterator[np.ndarray]:
        """For each depth what the starts reach at it first: place of the start, node, least label, as one number, in order."""
        lb, nb = self.lb, self.nb
        at = np.sort((np.arange(len(starts), dtype=np.int64) << (lb + nb)) | (starts.astype(np.int64) << lb))
        seen = front = at
        label = (1 << lb) - 1
        for depth in range(1, max_depth + 1):
            node = (front >> lb) & ((1 << nb) - 1)
            lo = self.begins[node]
            size = self.begins[node + 1] - lo
            ends = np.cumsum(size)
            new, a = [], 0
            known = seen
            while a < len(front):
                base = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, base + SLICE, "right")))
                n = size[a:b]
                step = self.edges[np.arange(ends[b - 1] - base) + np.repeat(lo[a:b] - (ends[a:b] - n - base), n)]
                own = front[a:b] >> (lb + nb) << (lb + nb)
                if self.carried and depth > 1:  # walked backward, a row keeps the label of its last step, which comes first
                    own, step = own | (front[a:b] & label), step >> lb << lb
                # Known rows have label 0 and so come first; of the others the least label does.
                x = np.concatenate([known, np.repeat(own, n) | step, *new])
                x.sort()
                key = x >> lb
                first = np.ones(len(x), bool)
                np.not_equal(key[1:], key[:-1], out=first[1:])
                x = x[first]
                new = [x[(x & label) != 0]]
                a = b
            front = new[0] if new else np.zeros(0, np.int64)
            yield front
            if depth < max_depth:
                seen = np.concatenate([seen, front >> lb << lb])
                seen.sort()

    def walks(self, starts: np.ndarray, max_depth: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Starts, as many at once as fit into a slice, with their levels."""
        most = min(TOGETHER, 1 << max(0, 62 - self.lb - self.nb))
        a, n = 0, min(16, most)
        while a < len(starts):
            part = starts[a : a + n]
            found = list(self.levels(part, max_depth))
            yield part, found
            a += len(part)
            n = int(max(1, min(most, 4 * n, n * SLICE // (2 * max(1, sum(map(len, found)))))))


class Walks:
    """What depends on seeds, for the columns that are asked for; see graph.impact()."""

    LABEL = ("edge_kind", "resolution", "via", "via_id")

    def __init__(self, seeds: DataFrame, every: DataFrame, types: dict, order, max_depth: int):
        """every: graph.steps(), cut; types: those of seed, id and LABEL; order: graph.step_order."""
        self.spark, self.every, self.order, self.max_depth = seeds.sparkSession, every, order, max_depth
        self.types = {"depth": IntegerType(), "n": LongType()} | types
        self.seeds = seeds.select("seed").filter("seed is not null").distinct()
        ids = every.select("at").union(every.select("id")).union(self.seeds).filter("at is not null").distinct()
        self.nodes = cut(numbered(ids.withColumnRenamed("at", "node"), [F.col("node")], "n"))

    def _node(self, df: DataFrame, col: str, name: str) -> DataFrame:
        return df.join(self.nodes.select(F.col("node").alias(col), F.col("n").alias(name)), col)

    def _graph(self, fine: bool, backward: bool) -> tuple[DataFrame, object, int]:
        """Labels (label, edge_kind, resolution, via, via_id) and the broadcast graph; unless fine, via and via_id tell only whether they are there."""
        steps = self.every
        if not fine:
            steps = steps.withColumns({"via": F.lit(None).cast("string"), "via_id": F.when(F.col("via_id").isNotNull(), F.lit(1))})
        steps = steps.filter("at is not null and id is not null and at != id").select("at", "id", *self.LABEL).distinct()
        labels = cut(numbered(steps.select(*self.LABEL).distinct(), self.order(), "label", 1))
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in self.LABEL]
        steps = steps.alias("s").join(labels.alias("l"), same[0] & same[1] & same[2] & same[3]).select("at", "id", "label")
        least = steps.groupBy("at", "id").agg(F.min("label").alias("label"))  # of steps between two ids only the first can count
        n_nodes, n_labels = self.nodes.count(), labels.count()
        nb, lb = _bits(n_nodes), _bits(n_labels)
        a, b = ("n_id", "n_at") if backward else ("n_at", "n_id")
        packed = self._node(self._node(least, "at", "n_at"), "id", "n_id").select(F.col(a).alias("x"), F.shiftleft(b, lb).bitwiseOR(F.col("label")).alias("edge"))

        def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                if batch.num_rows:
                    x, edge = (c.to_numpy() for c in batch.columns)
                    yield pa.record_batch([pa.array([x[0]]), pa.array([batch.num_rows]), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([edge.astype("<i8").tobytes()], pa.binary())], ["low", "size", "x", "edges"])

        chunks = packed.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(pack, "low long, size long, x binary, edges binary")
        with fleeting(self.spark):
            got = chunks.toArrow()
        # Ranges do not share an x, and within a range batches come in order: sorting by the first x restores the whole order.
        turn = np.argsort(got.column("low").to_numpy(), kind="stable")
        sizes = got.column("size").to_numpy()
        degree, edges, at = np.zeros(n_nodes + 1, np.int64), np.zeros(int(sizes.sum()), np.int64), 0
        for k in turn:
            x = np.frombuffer(got.column("x")[k].as_py(), "<i4")
            edges[at : at + len(x)] = np.frombuffer(got.column("edges")[k].as_py(), "<i8")
            at += len(x)
            degree[1 : n_nodes + 1] += np.bincount(x, minlength=n_nodes)
        del got
        return labels, self.spark.sparkContext.broadcast(Graph(np.cumsum(degree), edges, lb, nb, backward)), n_labels

    def _starts(self, of: DataFrame) -> DataFrame:
        # Neighbours by number tend to reach the same ids, of which files then hold each once.
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.nodes.count() // STARTS))
        return of.select("n").repartitionByRange(n, "n").sortWithinPartitions("n")

    def _about(self, about: DataFrame | None) -> tuple[np.ndarray | None, dict[str, pa.Array]]:
        """Of each node a number of its columns' values, or -1, and the values."""
        if about is None:
            return None, {}
        names = [c for c in about.columns if c != "id"]
        values = cut(numbered(about.select(*names).distinct(), [F.col(c) for c in names], "_v"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"v.{c}")) for c in names]
        on = same[0]
        for x in same[1:]:
            on = on & x
        each = self._node(about.alias("a").join(values.alias("v"), on).select("id", "_v"), "id", "n").select("n", "_v").toArrow()
        code = np.full(self.nodes.count(), -1, np.int32)
        code[each.column("n").to_numpy()] = each.column("_v").to_numpy()
        return code, dict(zip(names, _column(values, "_v", *names), strict=True))

    def _values(self, labels: DataFrame, columns, about: dict[str, pa.Array]) -> dict:
        asked = [c for c in self.LABEL if c in columns]
        tables = {c: pa.concat_arrays([pa.nulls(1, x.type), x]) for c, x in zip(asked, _column(labels, "label", *asked), strict=True)} if asked else {}
        if {"seed", "id"} & set(columns):
            tables["node"] = _column(self.nodes, "n", "node")[0]
        return tables | {f"about.{c}": x for c, x in about.items() if c in columns}

    def rows(self, *columns: str, about: DataFrame | None = None, dispatched: bool = False) -> DataFrame:
        """The walk's rows, of which columns are handed on; about (id, ...), one row an id, adds columns of the ids reached, and only ids that it has
        count; dispatched: only rows with a via_id."""
        return self._made(columns, about, dispatched, False)

    def tally(self, *columns: str, about: DataFrame | None = None) -> DataFrame:
        """(columns, n): how many rows have these values, added up for each group of starts; several rows may have the same values."""
        return self._made(columns, about, False, True)

    def _made(self, columns, about, dispatched: bool, counted: bool) -> DataFrame:
        labels, graph, _ = self._graph("via" in columns or "via_id" in columns, False)
        code, values = self._about(about)
        types = self.types | {c: about.schema[c].dataType for c in values}
        names = [*columns, "n"] if counted else list(columns)
        kind = StructType([StructField(c, types[c]) for c in names])
        schema = to_arrow_schema(kind)
        through = np.append(False, _column(labels, "label", "via_id")[0].is_valid().to_numpy(zero_copy_only=False)) if dispatched else None
        held = self.spark.sparkContext.broadcast((code, through, self._values(labels, columns, values)))
        max_depth, label_columns = self.max_depth, [c for c in self.LABEL if c in columns]

        def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, (code, through, tables) = graph.value, held.value
            lb, nb = g.lb, g.nb
            # Labels with the same values of the columns asked for are counted as one.
            group, groups = _grouped([tables[c] for c in label_columns])
            for batch in parts:
                for starts, found in g.walks(batch.column(0).to_numpy(), max_depth):
                    for depth, x in enumerate(found, 1):
                        label, node = x & ((1 << lb) - 1), (x >> lb) & ((1 << nb) - 1)
                        if code is not None or through is not None:
                            kept = np.ones(len(x), bool)
                            if code is not None:
                                kept &= code[node] >= 0
                            if through is not None:
                                kept &= through[label]
                            x, label, node = x[kept], label[kept], node[kept]
                        place, n = x >> (lb + nb), None
                        if counted:
                            parts_of = [(place, len(starts))] if "seed" in columns else []
                            parts_of += [(node, 1 << nb)] if "id" in columns else []
                            parts_of += [(code[node], int(code.max(initial=0)) + 1)] if any(f"about.{c}" in tables for c in columns) else []
                            parts_of += [(group[label], len(groups))] if label_columns else []
                            keep, n = _counted(parts_of, len(x))
                            place, node, label = place[keep], node[keep], label[keep]
                        for a in range(0, len(place), BATCH):
                            p, d, m = (v[a : a + BATCH] for v in (place, node, label))
                            out = []
                            for c in names:
                                if c == "seed":
                                    out.append(tables["node"].take(pa.array(starts[p])))
                                elif c == "id":
                                    out.append(tables["node"].take(pa.array(d)))
                                elif c == "depth":
                                    out.append(pa.array(np.full(len(p), depth, np.int32)))
                                elif c == "n":
                                    out.append(pa.array(n[a : a + BATCH]))
                                elif c in tables:
                                    out.append(tables[c].take(pa.array(m)))
                                else:
                                    out.append(tables[f"about.{c}"].take(pa.array(code[d])))
                            yield pa.record_batch([v.cast(f.type) for v, f in zip(out, schema, strict=True)], schema)

        return self._starts(self._node(self.seeds, "seed", "n")).mapInArrow(walk, kind)

    def best(self, merit, *columns: str) -> DataFrame:
        """Of each id reached its best row, by merit() and then by seed, with how many seeds reach it: columns of seed, id, depth, LABEL, seeds and
        changed. With changed there is one row for each seed that reaches the id: the best row's columns, and that seed. The walk goes backward
        from ids, so that all this is made in one place."""
        labels, graph, n_labels = self._graph(True, True)
        depths = labels.join(F.broadcast(self.spark.range(1, self.max_depth + 1).select(F.col("id").cast("int").alias("depth"))))
        ranked = numbered(depths.withColumn("seed", F.lit(0)), [*merit(), F.col("label")], "rank").select("rank", "label", "depth").toArrow()
        rank = np.zeros((self.max_depth + 1, n_labels + 1), np.int64)
        rank[ranked.column("depth").to_numpy(), ranked.column("label").to_numpy()] = ranked.column("rank").to_numpy()
        is_seed = np.zeros(self.nodes.count(), bool)
        is_seed[self._node(self.seeds, "seed", "n").select("n").toArrow().column("n").to_numpy()] = True
        types = self.types | {"seeds": LongType(), "changed": self.types["seed"]}
        kind = StructType([StructField(c, types[c]) for c in columns])
        schema = to_arrow_schema(kind)
        held = self.spark.sparkContext.broadcast((rank, is_seed, self._values(labels, ("id", *columns), {})))
        max_depth = self.max_depth

        def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, (rank, is_seed, tables) = graph.value, held.value
            lb, nb = g.lb, g.nb
            for batch in parts:
                for starts, found in g.walks(batch.column(0).to_numpy(), max_depth):
                    x = np.concatenate(found)
                    depth = np.repeat(np.arange(1, len(found) + 1), [len(v) for v in found])
                    node = (x >> lb) & ((1 << nb) - 1)
                    kept = is_seed[node]
                    x, depth, node = x[kept], depth[kept], node[kept]
                    label, place = x & ((1 << lb) - 1), x >> (lb + nb)
                    order = np.lexsort((node, rank[depth, label], place))
                    first = order[np.append(True, np.diff(place[order]) != 0)] if len(order) else order
                    n = np.bincount(place, minlength=len(starts))[place[first]]
                    at, changed = np.arange(len(first)), None
                    if "changed" in columns:
                        at, changed = np.repeat(at, n), node[np.lexsort((node, place))]
                    for a in range(0, len(at), BATCH):
                        k = at[a : a + BATCH]
                        row = first[k]
                        out = []
                        for c in columns:
                            if c == "changed":
                                out.append(tables["node"].take(pa.array(changed[a : a + BATCH])))
                            elif c in ("seed", "id"):
                                out.append(tables["node"].take(pa.array(node[row] if c == "seed" else starts[place[row]])))
                            elif c in ("depth", "seeds"):
                                out.append(pa.array(depth[row] if c == "depth" else n[k]))
                            else:
                                out.append(tables[c].take(pa.array(label[row])))
                        yield pa.record_batch([v.cast(f.type) for v, f in zip(out, schema, strict=True)], schema)

        return self._starts(self.nodes).mapInArrow(walk, kind)


def _grouped(tables: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct rows of tables, one for each row."""
    if not tables:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.zeros(len(tables[0]), np.int64)
    for x in tables:
        own = x.dictionary_encode("encode")
        codes = np.unique(codes * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes, np.unique(codes)


def _counted(parts: list[tuple[np.ndarray, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of each group of rows that agree in all parts (numbers, below a bound), and the groups' sizes."""
    if not parts or not n:
        return np.zeros(min(1, n), np.int64), np.full(min(1, n), n, np.int64)
    key, bound = parts[0][0].astype(np.int64), parts[0][1]
    for x, m in parts[1:]:
        if bound * m >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = n
        key, bound = key * m + x, bound * m
    if bound <= 4 * n + 1024:
        size = np.bincount(key, minlength=bound)
        some = np.zeros(bound, np.int64)
        some[key] = np.arange(n)
        there = np.flatnonzero(size)
        return some[there], size[there]
    _, first, size = np.unique(key, return_index=True, return_counts=True)
    return first, size
