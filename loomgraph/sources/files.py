"""Repository settings and source files."""

from __future__ import annotations

import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LANGUAGES, make_id

#: Folders left out unless a repository names its own.
EXCLUDED = ["**/node_modules/**", "**/build/**", "**/dist/**", "**/target/**", "**/.git/**", "**/.gradle/**", "**/out/**", "**/generated/**"]


def repo_configs(path: str) -> list[dict]:
    """A JSON array of {name, path, languages, exclude}; a missing file means none."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, list):
        raise ValueError("repository settings must be an array")
    return found


def repo_from_args(path: str, name: str | None = None) -> dict:
    full = os.path.abspath(path)
    return {"name": name or posixpath.basename(full.rstrip("/")), "path": full}


def glob_regex(glob: str) -> str:
    """A Java regular expression for a path glob."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif glob[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif glob[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + ("\\" + glob[at] if glob[at] in r".^$+{}[]()|\\" else glob[at]), at + 1
    return f"^{out}$"


def language(path):
    out = F.lit(None).cast("string")
    for ending, name in LANGUAGES.items():
        out = F.when(F.endswith(path, F.lit(ending)), name).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, repo: str, languages: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(id, repo_id, path, language, content_hash, content): source files below root. exclude replaces the usual folders."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Local paths are written with one slash after the scheme or with three.
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + "".join("\\" + c if c in r".^$*+?{}[]()|\\" else c for c in base.replace("file:///", "file:/")) + "/", "")
    files = raw.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content")).withColumn("language", language(F.col("path"))).filter("language is not null")
    if languages:
        files = files.filter(F.col("language").isin(*languages))
    for glob in EXCLUDED if exclude is None else exclude:
        files = files.filter(~F.col("path").rlike(glob_regex(glob)))
    return files.select(make_id(F.lit(repo), F.col("path")).alias("id"), F.lit(repo).alias("repo_id"), "path", "language", F.lower(F.hex(F.xxhash64("content"))).alias("content_hash"), "content")
