"""Closures and walks over edge tables, level by level; all seeds at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import first
from .walks import HELD, Walks


def closure(nodes: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, ancestor, depth): every node of nodes (node) with itself and all it reaches over edges (source, target) within
    max_depth steps, at the least depth. Each level joins only the pairs that the one before it made."""
    edges = cut(edges.select("source", "target").distinct())
    found = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    level = found = cut(found)
    for depth in range(1, max_depth + 1):
        step = level.join(edges, level["ancestor"] == edges["source"]).select("node", F.col("target").alias("ancestor")).distinct()
        level = cut(step.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def walk_up(starts: DataFrame, parents: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, id, grp): each start's parent as group 1, its parent's parent as 2, and so on; parents: (id, parent_id)."""
    level = starts.select("start", F.col("start").alias("id"))
    parents = parents.filter("parent_id is not null").select(F.col("id").alias("_of"), "parent_id")
    out = None
    for grp in range(1, max_depth + 1):
        level = cut(level.join(parents, level["id"] == parents["_of"]).select("start", F.col("parent_id").alias("id")))
        if level.isEmpty():
            break
        here = level.withColumn("grp", F.lit(grp))
        out = here if out is None else out.unionByName(here)
    return out if out is not None else level.withColumn("grp", F.lit(1))


def compatible(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Those pairs (cls, receiver) of classes that have a descendant, or themselves, in common; ancestors: (class_id, ancestor_id)."""
    below = pairs.select("cls", "receiver").distinct().join(ancestors.select("class_id", F.col("ancestor_id").alias("cls")), "cls")
    return below.join(ancestors.select("class_id", F.col("ancestor_id").alias("receiver")), ["class_id", "receiver"], "left_semi").select("cls", "receiver").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, direction, kind, other), one row each: what edges (source_id, target_id, kind) lead in from and out to."""
    into = edges.select(F.col("target_id").alias("id"), F.lit("in").alias("direction"), "kind", F.col("source_id").alias("other"))
    return into.unionByName(edges.select(F.col("source_id").alias("id"), F.lit("out").alias("direction"), "kind", F.col("target_id").alias("other"))).distinct()


def step_order() -> list[Column]:
    rank = F.when(F.col("edge_kind") == "overrides", 3).when(F.col("via_id").isNotNull(), 2).when(F.col("edge_kind") == "calls", 0).otherwise(1)
    return [rank, F.col("edge_kind"), F.col("resolution").asc_nulls_last(), F.col("via").asc_nulls_last(), F.col("via_id").asc_nulls_last()]


def steps(edges: DataFrame, symbols: DataFrame, ancestors: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(at, id, edge_kind, resolution, via, via_id): all steps of the walk, or those from the ids of at, which is small and is broadcast."""
    near = lambda df, col, ids: df if at is None else df.join(F.broadcast(ids.select(F.col(ids.columns[0]).alias(col)).distinct()), col, "left_semi")
    direct = near(edges, "target_id", at).select(F.col("target_id").alias("at"), F.col("source_id").alias("id"), F.col("kind").alias("edge_kind"), "resolution", F.lit(None).cast(symbols.schema["qualified_name"].dataType).alias("via"), F.lit(None).cast(edges.schema["target_id"].dataType).alias("via_id"))
    over = near(edges.filter("kind = 'overrides'"), "source_id", at).select(F.col("source_id").alias("at"), F.col("target_id").alias("via_id"))
    over = over.join(symbols.select(F.col("id").alias("at"), F.col("parent_id").alias("cls")), "at")
    over = over.join(symbols.select(F.col("id").alias("via_id"), F.col("qualified_name").alias("via")), "via_id")
    calls = edges.filter("kind = 'calls' and not (resolution <=> 'super')").select(F.col("target_id").alias("via_id"), F.col("source_id").alias("id"), F.col("kind").alias("edge_kind"), "resolution", F.col("receiver_class_id").alias("receiver"))
    through = over.join(calls, "via_id")
    known = through.filter("receiver is not null")
    known = known.join(compatible(known, ancestors), ["cls", "receiver"], "left_semi")
    through = known.unionByName(through.filter("receiver is null"))
    return direct.unionByName(through.select(direct.columns)).distinct()


#: Ids of a level from which the walk looks up single steps; beyond, the steps of the whole graph are made once for all levels.
FEW = 2_000
REACHED = ("seed", "id", "depth", "edge_kind", "resolution", "via", "via_id")


class Joined:
    """The rows of a walk by joins, handed on as Walks hands them on."""

    def __init__(self, reached: DataFrame):
        self.reached = reached

    def rows(self, *columns: str, about: DataFrame | None = None, dispatched: bool = False) -> DataFrame:
        rows = self.reached if about is None else self.reached.join(about, "id")
        return (rows.filter("via_id is not null") if dispatched else rows).select(*columns)

    def tally(self, *columns: str, about: DataFrame | None = None) -> DataFrame:
        return self.rows(*columns, about=about).groupBy(*columns).agg(F.count("*").alias("n"))

    def best(self, merit: Callable[[], list[Column]], *columns: str) -> DataFrame:
        seeds = self.reached.groupBy("id").agg(F.count("*").alias("seeds"))
        best = first(self.reached, ["id"], [*merit(), F.col("seed")]).join(seeds, "id")
        return (best.join(self.reached.select("id", F.col("seed").alias("changed")), "id") if "changed" in columns else best).select(*columns)


def reach(seeds: DataFrame, edges: DataFrame, symbols: DataFrame, ancestors: DataFrame, max_depth: int = 3, few: int = FEW, held: int = HELD) -> Walks | Joined:
    """What impact() says, for plans that need not all of it: rows(), tally() and best().

    From more than few seeds, and where the graph has at most held steps, tasks hold all steps and walk their own seeds; nothing that
    was reached is shuffled or written. Else levels are joined with the steps of few ids, or with those of the whole graph.
    """
    frontier = visited = cut(seeds.select("seed", F.col("seed").alias("id")).distinct())
    every, out = None, None
    if frontier.limit(few + 1).count() > few:
        every = cut(steps(edges, symbols, ancestors))
        if every.count() <= held:
            names = ("id", "edge_kind", "resolution", "via", "via_id")
            types = {x: every.schema[x].dataType for x in names} | {"seed": frontier.schema["seed"].dataType}
            return Walks(frontier, every, types, step_order, max_depth)
    for depth in range(1, max_depth + 1):
        at = frontier.select(F.col("id").alias("at")).distinct()
        if every is None and at.limit(few + 1).count() <= few:
            step = steps(edges, symbols, ancestors, at)
        else:
            step = every = every if every is not None else cut(steps(edges, symbols, ancestors))
        reached = frontier.select("seed", F.col("id").alias("at")).join(step, "at").filter("id != seed").drop("at")
        new = first(reached.join(visited, ["seed", "id"], "left_anti"), ["seed", "id"], step_order())
        new = cut(new.withColumn("depth", F.lit(depth)))
        out = new if out is None else out.unionByName(new)
        frontier = new.select("seed", "id")
        visited = visited.unionByName(frontier)
    return Joined(out.select(*REACHED))


def impact(seeds: DataFrame, edges: DataFrame, symbols: DataFrame, ancestors: DataFrame, max_depth: int = 3, few: int = FEW, held: int = HELD) -> DataFrame:
    """(seed, id, depth, edge_kind, resolution, via, via_id): what depends on each seed, at its least depth.

    seeds (seed); edges (source_id, target_id, kind, resolution, receiver_class_id); symbols (id, qualified_name, parent_id);
    ancestors (class_id, ancestor_id), reflexive. A method that is reached also stands for the methods it overrides: calls
    of these, other than by super, count unless their receiver's class has no descendant in common with its own class.

    What one step from an id gives does not depend on the seed: from few ids it is looked up, from many the steps of the whole
    graph are made once; see reach(). All ways give the same rows.
    """
    return reach(seeds, edges, symbols, ancestors, max_depth, few, held).rows(*REACHED)
