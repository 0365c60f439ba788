"""Walks in tasks that hold the graph, against walks by joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.symbols import confidence
from loomgraph.operators import graph, walks
from loomgraph.plans import changes, summary, ticket, tracing


@pytest.fixture(scope="module")
def both(spark):
    """(by held graphs, by joins) of one random graph with text ids, in which one seed is nowhere and one id is no seed."""
    rng = random.Random(3)
    rows = set()
    for _ in range(90):
        a, b = rng.sample(range(24), 2)
        kind = rng.choice(["calls", "calls", "overrides", "extends", "imports"])
        calls = kind == "calls"
        rows.add((f"n{a}", f"n{b}", kind, rng.choice(["local", "typed", "super", None]) if calls else None, rng.choice([None, "c0", "c1"]) if calls else None))
    edges = spark.createDataFrame(sorted(rows, key=repr), "source_id string, target_id string, kind string, resolution string, receiver_class_id string").withColumn("line", F.lit(1))
    symbols = spark.createDataFrame([(f"n{k}", f"q{k % 5}", f"c{k % 3}") for k in range(24)], "id string, qualified_name string, parent_id string")
    ancestors = spark.createDataFrame([("c0", "c0"), ("c1", "c1"), ("c1", "c0"), ("c2", "c2")], "class_id string, ancestor_id string")
    seeds = symbols.filter("id != 'n7'").select(F.col("id").alias("seed")).union(spark.createDataFrame([("nowhere",)], "seed string"))
    return tuple(graph.reach(seeds, edges, symbols, ancestors, 3, 0, held) for held in (walks.HELD, 0))


@pytest.fixture(scope="module")
def about(spark):
    """Of all ids but one, with a null."""
    return spark.createDataFrame([(f"n{k}", f"r{k % 2}", [None, "test", "dto"][k % 3]) for k in range(23)], "id string, repo string, archetype string")


def same(a, b):
    assert a.columns == b.columns
    got, want = (sorted(map(repr, map(tuple, x.collect()))) for x in (a, b))
    assert got == want and want


def after(df):
    """What a plan does with the rows that tasks made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return plan.split("MapInArrow")[0]


def test_f1_edge_kinds_are_counted_where_they_are_made(both):
    same(*(tracing.edge_kinds(x.tally("edge_kind")) for x in both))
    assert "Join" not in after(both[0].tally("edge_kind"))


def test_slices_and_groups_of_starts_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    at, to = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    order = np.argsort(at, kind="stable")
    for backward in (False, True):
        g = walks.Graph(np.searchsorted(at[order], np.arange(41)), (to[order] << 4) | rng.integers(1, 15, 300), 4, 6, backward)

        def rows():
            return [(int(s[x >> 10]), depth, int(x & 1023)) for s, found in g.walks(np.arange(40), 3) for depth, xs in enumerate(found, 1) for x in xs]

        want = rows()
        monkeypatch.setattr(walks, "SLICE", 5)
        assert sorted(rows()) == sorted(want) and len(want) > 1000
        monkeypatch.undo()


def test_f2_dispatched_rows_alone_are_handed_on(both):
    cols = ("seed", "id", "depth", "via", "via_id")
    same(*(x.rows(*cols, dispatched=True) for x in both))
    assert "Exchange" not in after(both[0].rows(*cols, dispatched=True))


def test_f3_best_rows_and_numbers_of_seeds(both):
    got, want = (changes.best_affected(x).select(*graph.REACHED, "confidence", "seeds") for x in both)
    same(got, want)
    merged = changes.merge_affected(both[1].rows(*graph.REACHED)).select(*graph.REACHED, "confidence", F.size("changed").cast("long").alias("seeds"))
    same(got, merged)
    assert "collect_set" not in after(got)


def test_f2_every_changed_symbol_is_listed(both):
    """Of each affected symbol all seeds that reach it, with its best row, as merge_affected() lists them."""
    got, want = (changes.affected_by(x) for x in both)
    same(got, want)
    merged = changes.merge_affected(both[1].rows(*graph.REACHED))
    same(got, merged.select("id", "depth", "edge_kind", "confidence", F.explode("changed").alias("changed")))
    assert "Join" not in after(got) and "Exchange" not in after(got)


def test_f4_tickets_by_repository(both, about):
    got, want = ticket.counted(both[0].tally("seed", "repo", "archetype", about=about)), ticket.by_repository(both[1].rows(*graph.REACHED), about)
    same(got, want)
    assert "Join" not in after(got)


def test_f5_hops(both):
    got, want = summary.hops(both[0].tally("seed", "depth")), summary.hops(both[1].rows(*graph.REACHED))
    same(got, want)
    assert "Join" not in after(got)


def test_f6_confidence_of_all_rows(both):
    same(*(x.rows("seed", "id", "depth", "edge_kind").withColumn("c", confidence(F.col("depth"), F.col("edge_kind"))) for x in both))


def test_f7_all_rows_without_a_shuffle_of_them(both):
    same(*(x.rows(*graph.REACHED) for x in both))
    assert "Exchange" not in after(both[0].rows(*graph.REACHED))


def test_f7_tasks_walk_from_neighbours(both):
    got = both[0]._starts(both[0].nodes).select(F.spark_partition_id().alias("p"), "n").collect()
    parts = {}
    for r in got:
        parts.setdefault(r.p, []).append(r.n)
    assert len(parts) > 1 and all(x == list(range(x[0], x[0] + len(x))) for x in parts.values())
    assert sum(map(len, parts.values())) == both[0].nodes.count()


def test_f9_archetypes(both, about):
    tags = about.drop("repo")
    got, want = summary.archetypes(both[0].tally("seed", "archetype", about=tags)), summary.archetypes(both[1].rows(*graph.REACHED), tags)
    same(got, want)
    assert "Join" not in after(got)


def test_f10_buckets(both):
    same(*(summary.buckets(x) for x in (both[0].tally("depth", "edge_kind"), both[1].rows(*graph.REACHED))))


def test_f11_listed_tests(both, about):
    tests = about.drop("repo").filter("archetype = 'test'")
    got = ticket.listed(both[0].rows("seed", "id", "depth", "edge_kind", "archetype", about=tests), cap=2)
    same(got, ticket.listed(both[1].rows(*graph.REACHED), about, tests=True, cap=2))
    assert "Join" not in after(got)


def test_f12_dispatched_callers(spark, both):
    got = both[0]
    got.max_depth = 1
    try:
        same(got.rows("seed", "id", dispatched=True), both[1].rows(*graph.REACHED).filter("depth = 1 and via_id is not null").select("seed", "id"))
    finally:
        got.max_depth = 3
