import itertools
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.engine import CodeGraph, TraceStore
from loomgraph.operators import graph, ranges
from loomgraph.plans import changes
from loomgraph.sources.extract import extract
from loomgraph.streaming import incremental

SOURCES = {
    "src/app/Store.java": """package app;
public interface Store { Item load(long id); void save(Item item); }
""",
    "src/app/Base.java": """package app;
public abstract class Base { protected void log(String m) { } public Item load(long id) { return null; } }
""",
    "src/app/FileStore.java": """package app;
public class FileStore extends Base implements Store {
    public Item load(long id) { log("x"); return super.load(id); }
    public void save(Item item) { item.touch(); }
    void put(String s) { } void put(Item i) { }
    public Item getFirst() { return null; }
    void both() { put("a"); put(new Item()); }
}
""",
    "src/app/Item.java": "package app;\npublic class Item {\n    public void touch() { }\n    public Item next() { return this; }\n}\n",
    "src/use/Service.kt": """package use
import app.Store
import app.Item
class Service(private val store: Store) {
    fun run(id: Long) { val item = store.load(id); store.save(item); helper() }
    fun chain(i: Item) { i.next().touch() }
    fun step(s: app.FileStore) { s.first.touch() }
}
fun helper() { }
""",
}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    g = CodeGraph(spark, f"file://{tmp_path_factory.mktemp('store')}/g")
    assert g.index(str(root), "demo")["changed"] == len(SOURCES)
    return g, root


def edges(g):
    s = g.symbols().select("id", "qualified_name", F.concat_ws(",", F.coalesce("param_types", F.array())).alias("p")).collect()
    name = {r.id: r.qualified_name for r in s}
    return {(name[e.source_id], name[e.target_id], e.kind, e.resolution) for e in g.table("edges").collect()}


def test_edges(indexed):
    got = edges(indexed[0])
    for e in [
        ("app.FileStore", "app.Base", "extends", None), ("app.FileStore", "app.Store", "implements", None), ("app.FileStore.load", "app.Store.load", "overrides", None), ("app.FileStore.load", "app.Base.load", "overrides", None),
        ("app.FileStore.load", "app.Base.log", "calls", "local"), ("app.FileStore.load", "app.Base.load", "calls", "super"), ("app.FileStore.save", "app.Item.touch", "calls", "typed"), ("use.Service.run", "app.Store.load", "calls", "typed"),
        ("use.Service.run", "use.helper", "calls", "local"), ("use.Service.chain", "app.Item.next", "calls", "typed"), ("use.Service.chain", "app.Item.touch", "calls", "chain"), ("use.Service.step", "app.Item.touch", "calls", "chain"), ("use.Service", "app.Store", "imports", None),
    ]:
        assert e in got, e


def test_overloads_are_narrowed(indexed):
    g, _ = indexed
    s = {r.id: (r.qualified_name, r.param_types) for r in g.symbols().collect()}
    put = sorted(str(s[e.target_id][1]) for e in g.table("edges").filter("kind = 'calls'").collect() if s[e.source_id][0] == "app.FileStore.both")
    assert put == ["['Item']", "['String']"]


def test_impact_goes_through_dispatch(indexed):
    g, _ = indexed
    rows = {r.qualified_name: r for r in g.impact(g.lookup("app.FileStore.load")).collect()}
    assert rows["use.Service.run"].via == "app.Store.load" and rows["use.Service.run"].confidence == 1.0
    context = {(r.direction, r.kind, r.qualified_name): r.place for r in g.symbol_context(g.lookup("app.FileStore.load")).collect()}
    assert context["in", "calls", "use.Service.run"] == 1 and ("out", "overrides", "app.Store.load") in context
    numbers = {k: [tuple(r) for r in v.collect()] for k, v in g.impact_summary(g.lookup("app.FileStore.load")).items()}
    assert sum(n for *_, n in numbers["hops"]) == len(rows) == sum(n for *_, n in numbers["confidence"]) == sum(n for *_, n in numbers["archetypes"]) and len(numbers["confidence"]) == 5


def test_search_outline_and_files(indexed):
    g, _ = indexed
    top = g.search(["file store", "Service"], 3).filter("place = 1").orderBy("query_id").collect()
    assert [r.qualified_name for r in top][1] == "use.Service"
    assert [r.path for r in g.list_files("demo", pattern="*.kt").collect()] == ["src/use/Service.kt"]
    assert [(r.name, r.depth, r.place) for r in g.file_outline("demo", "src/app/Item.java").collect()] == [("Item", 1, 1), ("touch", 2, 2), ("next", 2, 3)]
    assert [(r.path, r.truncated) for r in g.list_files("demo", limit=1).collect()] == [("src/app/Base.java", True)]
    assert [r.shown for r in g.read_source("demo", "src/app/Item.java", 2, 3).collect()] == ["2: public class Item {", "3:     public void touch() { }"]
    hit = g.search_pattern(r"touch\(\) \{", "demo").collect()
    assert [(r.path, r.line_no, len(r.before), len(r.after)) for r in hit] == [("src/app/Item.java", 3, 2, 2)]
    assert [(r.repo, r.truncated) for r in g.search_pattern("class", max_results=2, context=0).collect()] == [("demo", True)] * 2
    tickets = {k: v.collect() for k, v in g.analyze_tickets(["load item"], 2).items()}
    assert len(tickets["symbols"]) == 2 and {r.query_id for r in tickets["totals"]} == {0}
    assert tickets["totals"][0].affected == sum(r.affected for r in tickets["by_repo"]) == sum(r.affected for r in tickets["symbols"])
    assert all(r.place <= 25 <= 25 * r.total for r in tickets["context"]) and {r.bucket for r in tickets["context"]} <= {"callers", "callees", "extends", "implements", "extended_by", "implemented_by"}
    (repo,) = g.list_repos().collect()
    assert repo.symbols == repo.embedded == g.symbols().count() and repo.last_commit is None


def test_vectors_are_stored_and_only_missing_ones_are_made(indexed):
    g, _ = indexed
    assert g.embed("demo") == {"embedded": 0, "failed": 0}
    held = g.table("vectors")
    less = held.limit(held.count() - 3)
    g.store.write({"vectors": less})
    assert g.embed() == {"embedded": 3, "failed": 0} and g.table("vectors").count() == g.symbols().count()
    assert g.table("files").count() == len(SOURCES)  # tables of earlier versions are still there


def test_traces(indexed, monkeypatch):
    g, _ = indexed
    assert g.trace_ids == []
    monkeypatch.setenv("LOOMGRAPH_TRACE", "1")
    g.search(["item"], 2, trace=False)
    assert g.trace_ids == []
    g.search(["item"], 2)
    g.impact(g.lookup("app.Item.touch"))
    g.search_pattern("class", "demo", max_results=1)
    found = [g.traces.get(x) for x in g.trace_ids]
    assert [x["tool"] for x in found] == ["search", "impact", "search_pattern"]
    assert found[1]["total"] == sum(x["candidates"] for x in found[1]["hops"]) and found[2]["truncated"] and found[2]["returned"] == 1
    assert {x["stage"] for x in found[0]["stages"]} <= {"fts", "semantic", "name"}


def test_callers_against_an_oracle(indexed):
    g, _ = indexed
    oracle = {"repo": "demo", "commit": "abc", "symbols": [
        {"qualified_name": "app.FileStore.put", "intellij_signature": "FileStore.put(Item)", "file": "src/app/FileStore.java", "callers": [{"signature": "FileStore.both()", "file": "src/app/FileStore.java"}, {"signature": "Other.x(int)", "file": "src/app/Other.java"}, {"signature": "FileStore", "file": "src/app/FileStore.java"}]},
        {"qualified_name": "app.Gone.x", "callers": []}, {"qualified_name": "app.Bad.x", "error": "no such symbol"}]}
    report, notes = g.caller_report(oracle)
    assert {(r.entry, r.tests, r.tp, r.found, r.expected, r.precision, r.recall) for r in report.collect()} == {(0, True, 1, 1, 2, 1.0, 0.5), (0, False, 1, 1, 2, 1.0, 0.5)}
    assert len(notes) == 3


def test_incremental_runs_keep_other_edges(indexed):
    g, root = indexed
    before = edges(g)
    assert g.index(str(root), "demo")["changed"] == 0
    (root / "src/app/Item.java").write_text(SOURCES["src/app/Item.java"] + "// end\n")
    assert g.index(str(root), "demo")["changed"] == 1
    assert edges(g) == before
    (root / "src/use/Service.kt").unlink()
    assert g.index(str(root), "demo")["removed"] == 1
    assert not any(a.startswith("use.") for a, *_ in edges(g))


def test_changes(indexed):
    g, root = indexed
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    path = root / "src/app/Item.java"
    path.write_text(path.read_text().replace("touch() { }", "touch() { int a = 1; }"))
    got = g.detect_changes("demo")
    names = {r.id: r.qualified_name for r in g.symbols().collect()}
    assert {names[r.id] for r in got["changed"].collect()} == {"app.Item.touch"} and got["side"] == "head" and len(got["warnings"]) == 1
    assert [tuple(r) for r in got["totals"].collect()] == [(1, 1, 1)] and {r.edge_kind for r in got["by_edge_kind"].collect()} >= {"calls"}
    assert "app.FileStore.save" in {names[r.id] for r in got["affected"].collect()}


def test_sides_are_chosen_by_commit_and_content(indexed):
    g, root = indexed
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("commit", "-qam", "two")
    g.index(str(root), "demo")
    assert g.list_repos().collect()[0].last_commit
    path = root / "src/app/Item.java"
    path.write_text(path.read_text().replace("    public Item next", "    @Deprecated\n    public Item next"))
    got = g.detect_changes("demo", "HEAD")
    assert got["side"] == "head" and not got["warnings"]  # the commit of the index
    git("commit", "-qam", "three")
    names = {r.id: r.qualified_name for r in g.symbols().collect()}
    got = g.detect_changes("demo", "HEAD~1..HEAD")
    assert got["side"] == "base" and not got["warnings"]
    assert {names[r.id] for r in got["changed"].collect()} == {"app.Item.next"}  # lines inserted above a declaration
    assert g.detect_changes("demo", "HEAD~1..HEAD", "head")["warnings"]
    g.index(str(root), "demo")
    assert g.detect_changes("demo", "HEAD~1..HEAD")["side"] == "head"
    with pytest.raises(ValueError, match="side"):
        g.detect_changes("demo", side="left")


def test_impact_equals_a_walk_over_all_paths(spark):
    rng = random.Random(6)
    for _ in range(3):
        nodes, es = range(12), set()
        for _ in range(30):
            a, b = rng.sample(nodes, 2)
            kind = rng.choice(["calls", "calls", "overrides", "extends"])
            es.add((a, b, kind, rng.choice(["local", "super", None]) if kind == "calls" else None, rng.choice([None, 0, 1, 2]) if kind == "calls" else None))
        parent = {n: n % 3 for n in nodes}
        anc = {(0, 0), (1, 1), (2, 2), (1, 0)}
        compat = {(x, y) for (c, x), (d, y) in itertools.product(anc, anc) if c == d}

        def step(at):
            for s, t, kind, res, _ in es:
                if t == at:
                    yield s, kind, res, None
            for _, v in {(s, t) for s, t, kind, *_ in es if kind == "overrides" and s == at}:
                for s, t, kind, res, rec in es:
                    if t == v and kind == "calls" and res != "super" and (rec is None or (parent[at], rec) in compat):
                        yield s, kind, res, v

        want = set()
        for seed in nodes:
            best, level = {}, {seed}
            for depth in (1, 2, 3):
                found = {}
                for at in level:
                    for s, kind, res, via in step(at):
                        if s != seed and s not in best:
                            rank = 3 if kind == "overrides" else 2 if via is not None else 0 if kind == "calls" else 1
                            key = (rank, kind, res is None, res or "", via is None, f"n{via}" if via is not None else "", via or 0)
                            if s not in found or key < found[s][0]:
                                found[s] = key, (depth, kind, res, via)
                best |= {s: x[1] for s, x in found.items()}
                level = set(found)
            want |= {(seed, s, *x) for s, x in best.items()}
        edges_df = spark.createDataFrame([(a, b, k, 1, r, c) for a, b, k, r, c in es], "source_id long, target_id long, kind string, line int, resolution string, receiver_class_id int")
        symbols = spark.createDataFrame([(n, f"n{n}", parent[n]) for n in nodes], "id long, qualified_name string, parent_id int")
        got = graph.impact(symbols.select(F.col("id").alias("seed")), edges_df, symbols, spark.createDataFrame(sorted(anc), "class_id int, ancestor_id int"))
        assert {(r.seed, r.id, r.depth, r.edge_kind, r.resolution, r.via_id) for r in got.collect()} == want
        got = graph.impact(symbols.select(F.col("id").alias("seed")), edges_df, symbols, spark.createDataFrame(sorted(anc), "class_id int, ancestor_id int"), few=0)
        assert {(r.seed, r.id, r.depth, r.edge_kind, r.resolution, r.via_id) for r in got.collect()} == want


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "source long, target long")
    got = graph.closure(e.select(F.col("source").alias("node")).union(spark.createDataFrame([(4,)], "node long")), e)
    assert {(r.node, r.ancestor): r.depth for r in got.collect()}[1, 4] == 3 and got.count() == 13


def test_ranges_and_floor(spark):
    lines = spark.createDataFrame([("f", x) for x in (1, 2, 3, 7, 9, 9, 10)], "file string, line int")
    assert sorted((r.start_line, r.end_line) for r in ranges.runs(lines, ["file"]).collect()) == [(1, 3), (7, 7), (9, 10)]
    s = spark.createDataFrame([("c", "f", "class", None, 1, 10), ("m", "f", "method", "c", 3, 5)], "id string, file_id string, kind string, parent_id string, start_line int, end_line int")
    pick = lambda a, b: {(r.id, r.reason) for r in changes.select_changed(s, spark.createDataFrame([("f", a, b)], "file_id string, first int, last int")).collect()}
    assert pick(4, 4) == {("m", "hit")} and pick(7, 7) == {("c", "unknown")} and pick(3, 2) == {("c", "unknown")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.java").write_text("package p; class A { void m() { n(); } void n() { } }")
    seen = {}
    incremental.run(spark, f"file://{tmp_path}/in", "r", f"file://{tmp_path}/check", lambda t, n: seen.update({k: v.count() for k, v in t.items()})).awaitTermination()
    assert seen == {"symbols": 3, "imports": 0, "call_sites": 1, "inheritance_refs": 0, "body_nodes": 3}


def test_trace_store():
    now = [0.0]
    store = TraceStore(10, 2, lambda: now[0])
    a, b = store.put({"x": 1}), store.put({"x": 2})
    now[0] = 1
    c = store.put({"x": 3})
    assert store.get(a) is None and store.get(b) == {"x": 2} and store.get(c) == {"x": 3}
    now[0] = 11
    assert store.get(c) is None


def test_body_nodes():
    source = "class A {\n  int x = 1;\n  // note\n  void m() { x(); }\n  abstract void n();\n  static { go(); }\n  class B { }\n}"
    kinds = {(n["hit_kind"], n["start_line"]) for n in extract(source, "java")["nodes"] if n["owner"] == 0}
    assert kinds == {("header", 1), ("state", 2), ("comment", 3), ("member", 4), ("contract", 5), ("state", 6), ("member", 7)}


def test_extraction():
    got = extract("package a\nclass B(val c: C) : D(1), E {\n  fun f(x: Int = 1, vararg y: String): G<H>? { c.go(x) { } ; return null }\n}", "kotlin")
    f = got["symbols"][1]
    assert (f["qualified_name"], f["declared_type"], f["min_params"], f["max_params"]) == ("a.B.f", "G", 0, None)
    assert [(r["kind"], r["type_name"]) for r in got["refs"]] == [("extends", "D"), ("implements", "E")]
    assert [(c["receiver_type"], c["method_name"], c["arg_count"]) for c in got["calls"]] == [("C", "go", 2)]
    assert extract("", "java")["symbols"] == [] and extract("class { ( [ <", "java")["refs"] == []


def test_bins_lose_no_overlap(spark):
    rng = random.Random(2)
    spans = [(k, "f", a, a + rng.choice([0, 3, 70, 500])) for k, a in enumerate(rng.randint(1, 600) for _ in range(60))]
    given = [("f", a, a + rng.choice([-1, 0, 5, 200])) for a in (rng.randint(1, 700) for _ in range(60))]
    got = ranges.overlap(spark.createDataFrame(spans, "id int, file string, start_line int, end_line int"), spark.createDataFrame(sorted(set(given)), "file string, first int, last int"), ["file"])
    want = {(k, a, b) for k, _, s, e in spans for _, a, b in given if s <= b and e >= a}
    found = [(r.id, r.first, r.last) for r in got.select("id", F.col("first"), F.col("last")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_containers_are_found_by_lines_and_by_name(spark):
    s = spark.createDataFrame([("a", "f", "class", "p.A", 1, 9), ("b", "f", "class", "p.A.B", 1, 9), ("m", "f", "method", "p.A.m", 1, 9), ("c", "f", "class", "p.A", 11, 12)], "id string, file_id string, kind string, qualified_name string, start_line int, end_line int")
    assert [r.id for r in changes.containers_at(s, spark.createDataFrame([("f", 1, 9)], "file_id string, start_line int, end_line int")).collect()] == ["a"]
    assert [r.id for r in changes.containers_named(s, spark.createDataFrame([("f", "p.A")], "file_id string, qualified_name string")).collect()] == ["a"]
