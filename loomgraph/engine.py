"""The engine's API: index repositories into fact tables and edges, and ask about them. Every method returns DataFrames."""

from __future__ import annotations

import json
import secrets
import time
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import glob_to_like, safe_path
from .functions.symbols import archetype, confidence, embedding_text
from .operators.graph import impact as walk_impact
from .operators.graph import neighbours
from .operators.ranking import numbered
from .plans import changes, evaluate, reading, resolve, search, summary, ticket, tracing
from .schema import LANGUAGES
from .session import cut
from .sources import diffs, extract, files
from .sources.store import Store, differing, stale, upsert, without_files

DIMS = 384
#: The extractor's version, kept with each repository.
EXTRACTOR = 2


def embed(text):
    """A column of DIMS-long unit vectors of hashed character trigrams; null for an empty text."""

    @F.arrow_udf("array<float>")
    def each(texts: pa.Array) -> pa.Array:
        import zlib

        out = []
        for t in texts.to_pylist():
            v = np.zeros(DIMS)
            low = f" {(t or '').lower()} "
            for k in range(len(low) - 2):
                h = zlib.crc32(low[k : k + 3].encode())
                v[h % DIMS] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n).astype(np.float32).tolist() if n and (t or "").strip() else None)
        return pa.array(out, pa.list_(pa.float32()))

    return each(text)


class TraceStore:
    """Traces by id for a time; the one that ends soonest makes room for a new one."""

    def __init__(self, ttl: float = 600, size: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.size, self.clock, self.held = ttl, size, clock, {}

    def put(self, trace: dict) -> str:
        now = self.clock()
        self.held = {k: v for k, v in self.held.items() if v[0] > now}
        while len(self.held) >= self.size:
            del self.held[min(self.held, key=lambda k: self.held[k][0])]
        key = secrets.token_hex(8)
        self.held[key] = (now + self.ttl, json.dumps(trace))
        return key

    def get(self, key: str) -> dict | None:
        found = self.held.get(key)
        return None if found is None or found[0] <= self.clock() else json.loads(found[1])


class CodeGraph:
    """A graph kept in a folder; see sources.store for its versions. With tracing (an argument, or the environment's setting), a
    query puts a summary of what it did into `traces`, whose id is the last of `trace_ids`."""

    def __init__(self, spark: SparkSession, folder: str, traces: TraceStore | None = None):
        self.spark, self.store = spark, Store(spark, folder)
        self.traces, self.trace_ids = traces or TraceStore(), []

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _traced(self, asked: bool | None, make: Callable[[], dict]) -> None:
        if tracing.wanted(asked):
            self.trace_ids.append(self.traces.put(make()))

    # Indexing

    def index(self, root: str, repo: str | None = None, languages: list[str] | None = None, exclude: list[str] | None = None, full: bool = False, vectors: bool = True) -> dict[str, int]:
        """Index a source tree: files that changed are parsed again, then all edges of the graph are rebuilt and swapped in."""
        repo = repo or root.rstrip("/").rsplit("/", 1)[-1]
        now = cut(files.walk(self.spark, root, repo, languages, exclude))
        held = self.table("files")
        mine = held.filter(F.col("repo_id") == repo)
        known = mine.limit(0) if full else mine
        marked = differing(now, known.select("path", "content_hash"))
        fresh = cut(marked.filter("changed"))
        gone = cut(stale(mine, now).select("id").unionByName(fresh.select("id")).distinct() if not full else mine.select("id"))
        numbers = {"files": now.count(), "changed": fresh.count(), "removed": gone.count()}
        about = self.spark.createDataFrame([(repo, repo, root, diffs.head_commit(root), EXTRACTOR)], "id string, name string, path string, last_commit string, extractor_version int")
        about = about.withColumns({"indexed_at": F.current_timestamp(), "created_at": F.current_timestamp()})
        made = {"repos": upsert(self.table("repos"), about, "name", keep=["created_at"])}
        if numbers["changed"] or numbers["removed"]:
            if fresh.filter(F.col("language").isin("typescript", "tsx")).limit(1).count():
                warnings.warn("calls in TypeScript files are not extracted", stacklevel=2)
            parsed = cut(extract.facts(fresh))
            facts = {n: without_files(self.table(n), gone).unionByName(df) for n, df in extract.tables(parsed).items()}
            new = fresh.join(parsed.select(F.col("file_id").alias("id"), "package_name"), "id").select("id", "repo_id", "path", "language", "content_hash", "package_name", F.current_timestamp().alias("indexed_at"))
            facts["files"] = held.join(gone, "id", "left_anti").unionByName(new)
            facts = {n: cut(df) for n, df in facts.items()}
            # A symbol that was parsed again keeps its id, but its text may be another.
            kept = self.table("vectors").join(facts["symbols"].join(fresh.select(F.col("id").alias("file_id")), "file_id", "left_anti").select("id"), "id", "left_semi")
            made |= {**facts, **resolve.rebuild(facts), "vectors": cut(kept)}
        numbers["version"] = self.store.write(made)
        if vectors:
            numbers |= self.embed(repo)
        return numbers

    def embed(self, repo: str | None = None) -> dict[str, int]:
        """Vectors for the symbols that have none, stored beside the others. Symbols that cannot be embedded are counted and left
        without; they hold nothing up, and the next call tries them again."""
        s, held = self.symbols(), self.table("vectors")
        s = s if repo is None else s.filter(F.col("repo") == repo)
        text = embedding_text(F.col("qualified_name"), F.col("signature"), F.col("doc_comment"))
        made = cut(s.join(held.select("id"), "id", "left_anti").select("id", embed(text).alias("embedding")))
        failed = made.filter(F.col("embedding").isNull() | (F.size("embedding") != DIMS)).count()
        new = made.filter(F.size("embedding") == DIMS)
        count = new.count()
        if count:
            self.store.write({"vectors": cut(held.unionByName(new))})
        return {"embedded": count, "failed": failed}

    # Reading

    def symbols(self) -> DataFrame:
        f = self.table("files").select(F.col("id").alias("file_id"), "path", "language", F.col("repo_id").alias("repo"))
        return self.table("symbols").join(f, "file_id")

    def _tagged(self) -> DataFrame:
        return self.symbols().withColumn("archetype", archetype(F.col("name"), F.col("qualified_name"), F.col("path"), F.col("kind")))

    def list_repos(self) -> DataFrame:
        """repos with the numbers of their symbols and of those with a vector."""
        with_vectors = self.symbols().select("id", F.col("repo").alias("name")).join(self.table("vectors").select("id", F.lit(1).alias("_has")), "id", "left")
        counts = with_vectors.groupBy("name").agg(F.count("*").alias("symbols"), F.count("_has").alias("embedded"))
        zero = F.lit(0).cast("long")
        return self.table("repos").join(counts, "name", "left").withColumns({"symbols": F.coalesce("symbols", zero), "embedded": F.coalesce("embedded", zero)})

    def lookup(self, qualified_name: str, repo: str | None = None) -> DataFrame:
        """The first symbol of exactly that qualified name."""
        s = self.symbols().filter(F.col("qualified_name") == qualified_name)
        return (s if repo is None else s.filter(F.col("repo") == repo)).orderBy("repo", "path", "start_line", "id").limit(1)

    def search(self, queries: list[str], limit: int = 10, repo: str | None = None, kind: str | None = None, language: str | None = None, trace: bool | None = None) -> DataFrame:
        q = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        s, vectors = self.symbols(), self.table("vectors")
        asked = q.select("query_id", embed(F.col("query")).alias("embedding")).filter("embedding is not null")
        found, legs = search.hybrid_legs(q, asked, s, vectors, limit, repo, kind, language)
        self._traced(trace, lambda: tracing.search_trace({"queries": queries, "limit": limit, "repo": repo, "kind": kind, "language": language}, search.trace(legs)))
        return found

    def _walk(self, seeds: DataFrame, max_depth: int) -> DataFrame:
        return walk_impact(seeds, self.table("edges"), self.table("symbols").select("id", "qualified_name", "parent_id"), self.table("class_ancestors"), max_depth)

    def impact(self, seeds: DataFrame, max_depth: int = 3, archetype_exclude: list[str] | None = None, trace: bool | None = None) -> DataFrame:
        """All that depends on seeds (id), with confidence and archetype, best first."""
        rows = self._walk(seeds.select(F.col("id").alias("seed")), max_depth)
        self._traced(trace, lambda: tracing.impact_trace({"max_depth": max_depth, "archetype_exclude": archetype_exclude}, rows))
        about = self._tagged().select("id", "name", "qualified_name", "kind", "path", "repo", "archetype")
        rows = rows.join(about, "id").withColumn("confidence", confidence(F.col("depth"), F.col("edge_kind")))
        if archetype_exclude:
            rows = rows.filter(~F.col("archetype").isin(*archetype_exclude))
        return rows.orderBy(F.desc("confidence"), "depth", "seed", "id")

    def impact_summary(self, seeds: DataFrame, max_depth: int = 3) -> dict[str, DataFrame]:
        """Of seeds (id): what was reached by depth, by archetype and by bucket of confidence."""
        rows = cut(self._walk(seeds.select(F.col("id").alias("seed")), max_depth))
        return {"hops": summary.hops(rows), "archetypes": summary.archetypes(rows, self._tagged().select("id", "archetype")), "confidence": summary.buckets(rows)}

    def symbol_context(self, ids: DataFrame) -> DataFrame:
        """(id, direction, kind, place, other, qualified_name), one row a neighbour of ids (id); callers by dispatch follow direct ones."""
        ids = ids.select("id").distinct()
        e = self.table("edges").filter("kind != 'imports'")
        direct = neighbours(e).join(ids, "id", "left_semi").withColumn("late", F.lit(0))
        near = self._walk(ids.select(F.col("id").alias("seed")), 1).filter("via_id is not null").select(F.col("seed").alias("id"), F.lit("in").alias("direction"), F.lit("calls").alias("kind"), F.col("id").alias("other")).distinct()
        near = near.join(direct.drop("late"), ["id", "direction", "kind", "other"], "left_anti").withColumn("late", F.lit(1))
        rows = direct.unionByName(near).join(self.symbols().select(F.col("id").alias("other"), "qualified_name"), "other")
        return numbered(rows, ["id", "direction", "kind"], [F.col("late"), F.col("qualified_name"), F.col("other")], "place").drop("late")

    def analyze_tickets(self, tickets: list[str], top_k: int = 5, max_depth: int = 2, repo: str | None = None) -> dict[str, DataFrame]:
        """For each symbol that a ticket's search finds: numbers (symbols), neighbours (context), affected symbols and tests (affected,
        tests), by repository (by_repo); and each ticket's totals."""
        found = cut(self.search(tickets, top_k, repo).select("query_id", "place", "id"))
        ids, about = found.select("id").distinct(), self._tagged().select("id", "repo", "archetype")
        reached = cut(self._walk(ids.select(F.col("id").alias("seed")), max_depth))
        edges, s = self.table("edges"), self.table("symbols").select("id", "qualified_name", "parent_id")
        by_repo = ticket.by_repository(reached, about)
        return {
            "symbols": ticket.analyze(found, s, edges, self.table("class_ancestors"), max_depth, reached), "context": ticket.context(ids, edges, reached), "affected": ticket.listed(reached, about),
            "tests": ticket.listed(reached, about, tests=True), "by_repo": by_repo, "totals": ticket.totals(found, by_repo, about),
        }

    def file_outline(self, repo: str, path: str) -> DataFrame:
        """Symbols of a file and their children, as a reader meets them; grandchildren are left out."""
        s = self.symbols().filter((F.col("repo") == repo) & (F.col("path") == path))
        rows = reading.outline(s.select("file_id", "id", "parent_id", "name", "kind", "start_line", "end_line", "signature"), ["file_id"])
        return rows.orderBy("place")

    def list_files(self, repo: str, path: str | None = None, pattern: str | None = None, limit: int = 200) -> DataFrame:
        """(path, language, truncated): truncated says that there are more than limit."""
        f = self.table("files").filter(F.col("repo_id") == repo)
        if path:
            f = f.filter(F.startswith("path", F.lit(path.rstrip("/") + "/")))
        if pattern:
            f = f.filter(F.col("path").like(glob_to_like(pattern)))
        few = f.select("path", "language").orderBy("path").limit(limit + 1)
        return few.withColumn("truncated", F.lit(few.count() > limit)).orderBy("path").limit(limit)

    def _root(self, repo: str) -> str:
        return self.table("repos").filter(F.col("name") == repo).select("path").collect()[0]["path"]

    def read_source(self, repo: str, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """(line_no, shown) of a file's lines start to end, as `n: text`."""
        full = safe_path(self._root(repo), path)
        if full is None:
            raise ValueError("path must lie below the repository")
        raw = self.spark.read.format("binaryFile").load(full)
        return reading.shown(reading.lines(raw, F.decode("content", "UTF-8")), start, end).orderBy("line_no")

    def search_pattern(self, pattern: str, repo: str | None = None, path_glob: str | None = None, max_results: int = 20, context: int = 2, trace: bool | None = None) -> DataFrame:
        """(repo, path, line_no, line, before, after, truncated) of lines that match a Java regular expression, in one repository or in all; a
        file gives twice max_results at most."""
        repos = [r["name"] for r in self.table("repos").select("name").orderBy("name").collect() if repo in (None, r["name"])]
        trees = [files.walk(self.spark, self._root(r), r).select(F.col("repo_id").alias("repo"), "path", "content") for r in repos]
        if not trees:
            raise ValueError("no such repository")
        f = trees[0]
        for x in trees[1:]:
            f = f.unionByName(x)
        if path_glob:
            f = f.filter(F.col("path").like(glob_to_like(path_glob)))
        rows = reading.lines(f, F.col("content"), "repo", "path")
        found = cut(reading.limited(reading.matches(rows, pattern, ["repo", "path"], context), ["repo", "path"], max_results, 2 * max_results))
        self._traced(trace, lambda: tracing.pattern_trace({"pattern": pattern, "repo": repo, "path_glob": path_glob, "max_results": max_results}, reading.match_counts(rows, pattern, "repo", "path"), found.count()))
        return found.orderBy("repo", "path", "line_no")

    # Changes

    def _holds(self, repo: str, paths: list[str], read: Callable[[str], str | None]) -> tuple[int, int]:
        """How many of paths are indexed, and how many of these have other content than read gives."""
        held = self.table("files").filter(F.col("repo_id") == repo).select("path", "content_hash")
        texts = self.spark.createDataFrame([(p, read(p)) for p in paths], "path string, content string")
        row = texts.join(held, "path").agg(F.count("*").alias("n"), F.count(F.when(~F.lower(F.hex(F.xxhash64("content"))).eqNullSafe(F.col("content_hash")) | F.col("content").isNull(), 1)).alias("other")).collect()[0]
        return row["n"], row["other"]

    def detect_changes(self, repo: str, ref: str | None = None, side: str | None = None, max_depth: int = 3, trace: bool | None = None) -> dict[str, object]:
        """changed symbols of a git diff, and what they reach merged over all of them; with the side of the diff that the index was
        compared with, and warnings where it may hold neither.

        Without a side, an index made at the diff's base is taken for the base's, unless the files' contents say that it holds the head.
        """
        if side not in (None, "base", "head"):
            raise ValueError("side must be base or head")
        root = self._root(repo)
        indexed = self.table("repos").filter(F.col("name") == repo).select("last_commit").collect()[0]["last_commit"]
        base, head = between = diffs.sides(root, ref)
        hunks = cut(diffs.hunks(diffs.git_diff(self.spark, root, ref, between)))
        paths = {k: sorted(r["path"] for r in hunks.filter(F.col("side") == k).select("path").distinct().collect()) for k in ("base", "head")}  # a diff's files, which git listed here
        contents = diffs.Contents(root, base, head)
        held = {k: self._holds(repo, paths[k], lambda p, k=k: contents.read(k, p)) for k in paths}
        now = (diffs.head_commit(root) or diffs.EMPTY_TREE) if head is None else None
        chosen = side or ("base" if indexed == base and (head is not None or indexed != now) else "head")
        sure = {k: n > 0 and other == 0 for k, (n, other) in held.items()}
        if side is None and chosen == "base" and held["base"][1] and sure["head"]:
            chosen = "head"
        doubts = [] if sure[chosen] else diffs.doubts(repo, chosen, indexed, base, head or now, held["base"])
        f = self.table("files").filter(F.col("repo_id") == repo).select(F.col("id").alias("file_id"), "path")
        ranges = hunks.filter(F.col("side") == chosen).join(f, "path").select("file_id", "first", "last", "head_first", "head_last").distinct()
        s, nodes = self.table("symbols"), self.table("body_nodes")
        if chosen == "base":
            above = hunks.filter("side = 'base' and last < first and head_path is not null").join(f, "path").select("file_id", "head_path").distinct().collect()
            texts = [(r["file_id"], contents.read("head", r["head_path"]), next((v for k, v in LANGUAGES.items() if r["head_path"].endswith(k)), None)) for r in above]
            heads = self.spark.createDataFrame([x for x in texts if x[1] is not None and x[2] is not None], "id string, content string, language string")
            ranges = changes.insertions_above(ranges, s, cut(extract.facts(heads).select(F.inline("symbols"))))
        changed = cut(changes.select_changed(s, ranges.select("file_id", "first", "last").distinct(), nodes))
        reached = cut(self._walk(changed.select(F.col("id").alias("seed")), max_depth))
        self._traced(trace, lambda: tracing.change_trace({"repo": repo, "ref": ref, "side": chosen}, between, doubts, hunks, changed, reached))
        merged = changes.merge_affected(reached).orderBy(*changes.affected_order()[:5], "id")
        return {"changed": changed, "affected": merged, "by_edge_kind": tracing.edge_kinds(reached), "hunks": hunks, "totals": diffs.line_totals(hunks), "side": chosen, "warnings": doubts}

    # Evaluation

    def caller_report(self, oracle: dict) -> tuple[DataFrame, list[str]]:
        """evaluate.caller_report() of an oracle {repo, commit, symbols: [{qualified_name, intellij_signature, file, callers, error}]}, and notes on
        entries that it left out or could not tell apart."""
        entries, callers, notes = [], [], []
        for k, x in enumerate(oracle["symbols"]):
            if x.get("error"):
                notes.append(f"{x['qualified_name']}: left out, {x['error']}")
                continue
            entries.append((k, x["qualified_name"], x.get("intellij_signature"), x.get("file")))
            callers += [(k, c["signature"], c["file"]) for c in x.get("callers") or []]
        listed = self.spark.createDataFrame(entries, "entry int, qualified_name string, signature string, file string")
        s = self._tagged().filter(F.col("repo") == oracle["repo"])
        meant = cut(evaluate.oracle_symbols(listed, s))
        several = {r["entry"]: r["n"] for r in meant.groupBy("entry").agg(F.count("*").alias("n")).collect()}
        notes += [f"{name}: not in the index" if k not in several else f"{name}: {several[k]} overloads scored as one" for k, name, *_ in entries if several.get(k) != 1]
        commit = self.table("repos").filter(F.col("name") == oracle["repo"]).select("last_commit").collect()
        if oracle.get("commit") and not (commit and (commit[0]["last_commit"] or "").startswith(oracle["commit"])):
            notes.append("the index was made at another commit than the oracle")
        reached = self._walk(meant.select(F.col("id").alias("seed")).distinct(), 1)
        return evaluate.caller_report(listed, self.spark.createDataFrame(callers, "entry int, signature string, file string"), s, reached), notes
