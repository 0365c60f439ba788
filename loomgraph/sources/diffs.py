"""Unified diffs as rows of hunks."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import redact, short_commit

HUNKS = "diff_id string, side string, path string, head_path string, first int, last int, added int, removed int, head_first int, head_last int"
#: Git's formats: a file's header up to its paths, a hunk's header, and the letters of escapes in quoted paths.
_HEADER = re.compile(r"\A(?:(?!@@ |--- ).*\n)*--- (?P<old>.*)\n\+\+\+ (?P<new>.*)$", re.M)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.M)
_ESCAPES = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v", b'"': b'"', b"\\": b"\\"}
_ESCAPED = re.compile(rb"\\([0-3][0-7]{2}|.)", re.S)


def unquoted(text: str) -> str:
    """A path as git prints it: quoted with octal bytes, or plain and ended by a tab. An escape that git doesn't write stays as it is."""
    if len(text) < 2 or not text.startswith('"') or '"' not in text[1:]:
        return text.split("\t", 1)[0]
    inside = text[1 : text.rindex('"')].encode()
    plain = _ESCAPED.sub(lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[0]), inside)
    return plain.decode("utf-8", "replace")


def side_path(text: str) -> str | None:
    path = unquoted(text)
    return None if path == "/dev/null" else path[2:] if path[:2] in ("a/", "b/") else path


def parse(diff: str) -> Iterator[tuple]:
    """(side, path, head path, first, last, added, removed, head first, head last) for each side of each hunk of a diff without context.

    Files begin at their `diff --git` lines, and a file without a pair of paths (renamed only, or binary) has no hunks. The head side has
    the new lines, or the old numbers where a hunk only deletes. The base side has the old lines; where a hunk only
    inserts, an empty range after them. A new file has no base side; a deleted file's head side stands under its old path.
    """
    for block in re.split(r"(?m)^diff --git ", diff)[1:]:
        header = _HEADER.match(block)
        if header is None:
            continue
        old, new = side_path(header["old"]), side_path(header["new"])
        for m in _HUNK.finditer(block, header.end()):
            old_first, removed, new_first, added = (int(x) if x is not None else 1 for x in m.groups())
            new_last = new_first + added - 1
            lines = added, removed, new_first, new_last
            if (path := new if new is not None else old) is not None:
                yield "head", path, new, *((new_first, new_last) if added else (old_first, old_first + removed - 1)), *lines
            if old is not None:
                yield "base", old, new, *((old_first, old_first + removed - 1) if removed else (old_first + 1, old_first)), *lines


def line_totals(hunks: DataFrame) -> DataFrame:
    """(files, added, removed): one row of totals."""
    head = hunks.filter("side = 'head'")
    zero = F.lit(0).cast("long")
    return head.agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum("added"), zero).alias("added"), F.coalesce(F.sum("removed"), zero).alias("removed"))


def hunks(diffs: DataFrame) -> DataFrame:
    """HUNKS for diffs (diff_id, diff); null diffs have none. Each text is parsed where it lies."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [x.split()[0] for x in HUNKS.split(", ")]
        for part in parts:
            rows = [(i, *row) for i, text in zip(part["diff_id"], part["diff"], strict=True) if text is not None for row in parse(text)]
            yield pd.DataFrame(rows, columns=cols)

    return diffs.selectExpr("cast(diff_id as string) as diff_id", "diff").mapInPandas(each, HUNKS)


# Git, on the driver ---------------------------------------------------------------------------------------------------

#: The tree without entries: a fixed value of git's object format.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def run_git(repo: str, *args: str, check: bool = True) -> str:
    try:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    except FileNotFoundError:  # no git on this machine
        if check:
            raise
        return ""
    if check and done.returncode:
        raise RuntimeError(redact(done.stderr.decode("utf-8", "replace").strip(), repo))
    return done.stdout.decode("utf-8", "replace")


def head_commit(repo: str) -> str | None:
    return run_git(repo, "rev-parse", "--verify", "-q", "HEAD", check=False).strip() or None


def diff_args(revisions: list[str]) -> list[str]:
    """Settings pinned, so that a user's own do not change the output."""
    return ["-c", "core.quotepath=true", "-c", "diff.noprefix=false", "-c", "diff.mnemonicPrefix=false", "diff", "--no-color", "--no-ext-diff", "--unified=0", "--find-renames", "--src-prefix=a/", "--dst-prefix=b/", *revisions, "--"]


def sides(repo: str, ref: str | None) -> tuple[str, str | None]:
    """(base, head): commits that ref means, head None for the working tree.

    None: HEAD to the working tree; a: a to the working tree; a..b, a...b (from the merge base), X^! and X^-n (a commit against
    its parent); without any commit the empty tree.
    """
    commit = lambda x: run_git(repo, "rev-parse", "--verify", "-q", f"{x}^{{commit}}").strip()
    if ref is None or not ref.strip():
        return head_commit(repo) or EMPTY_TREE, None
    ref = ref.strip()
    if ref.startswith("-"):
        raise ValueError("a revision must not begin with '-'")
    if ref.startswith(":/"):
        return commit(ref), None
    if "..." in ref:
        a, b = (x or "HEAD" for x in ref.split("...", 1))
        return run_git(repo, "merge-base", commit(a), commit(b)).strip(), commit(b)
    if ".." in ref:
        a, b = (x or "HEAD" for x in ref.split("..", 1))
        return commit(a), commit(b)
    if ref.endswith("^!"):
        parent = run_git(repo, "rev-parse", "--verify", "-q", f"{ref[:-2]}^1", check=False).strip()
        return parent or EMPTY_TREE, commit(ref[:-2])
    if m := re.fullmatch(r"(.+)\^-(\d*)", ref):
        return commit(f"{m[1]}^{m[2] or 1}"), commit(m[1])
    return commit(ref), None


def git_diff(spark: SparkSession, repo: str, ref: str | None = None, between: tuple[str, str | None] | None = None) -> DataFrame:
    """(diff_id, diff): one row per changed file, so that a large diff is parsed in parallel."""
    base, head = sides(repo, ref) if between is None else between
    text = run_git(repo, *diff_args([base, *([head] if head else [])]))
    files = ["diff --git " + x for x in re.split(r"(?m)^diff --git ", text)[1:]]
    return spark.createDataFrame([(str(k), x) for k, x in enumerate(files)], "diff_id string, diff string")


def doubts(repo: str, side: str, indexed: str | None, base: str, head: str | None, compared: tuple[int, int]) -> list[str]:
    """Why an index may not hold the side of a diff that it is compared with; compared: the base's indexed files, and those that differ."""
    said = short_commit(indexed) or "no recorded commit"
    if side == "base" and indexed != base:
        return [f"The index of {repo} is at {said}, but the diff's base is {short_commit(base)}: lines of the base may not be those of the index. Index the base again, or ask for side head."]
    if side == "base" and compared[1]:
        return [f"The index of {repo} is at the diff's base {said}, but {compared[1]} of {compared[0]} changed files had other content when it was made. Index the base again."]
    if side == "head" and head and indexed != head:
        return [f"The index of {repo} is at {said}, but the diff's head is at {short_commit(head)}: lines of the head may not be those of the index. Index the head again, or ask for side base."]
    return []


class Contents:
    """Files' texts on the two sides of a diff, each read once; None for what isn't there."""

    def __init__(self, repo: str, base: str, head: str | None):
        self.repo, self.commits, self.held = repo, {"base": base, "head": head}, {}

    def read(self, side: str, path: str) -> str | None:
        key = side, path
        if key not in self.held:
            self.held[key] = blob(self.repo, self.commits[side], path)
        return self.held[key]


def blob(repo: str, commit: str | None, path: str) -> str | None:
    """A file's text at a commit, as it would be checked out, or in the working tree."""
    if commit is None:
        try:
            with open(f"{repo}/{path}", "rb") as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None
    done = subprocess.run(["git", "-C", repo, "cat-file", "--filters", f"{commit}:{path}"], capture_output=True, check=False)
    return None if done.returncode else done.stdout.decode("utf-8", "replace")
