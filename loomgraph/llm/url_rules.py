"""URL filters: a sort-merge range join of urls with nested host rules.

A host's canonical key is its labels in reverse, each followed by a dot: `www.example.net` becomes `net.example.www.`. All
hosts that a rule's host covers then lie in one interval of keys, from the rule's own key up to that key followed by the
highest character, and any two intervals are nested or apart. Urls and rules are dealt out by ranges of the key and
sorted; a sweep over a range keeps a stack with the rules whose intervals contain the place it has reached, and the
stack's rules are asked for the longest whose path begins the url's.

Ranges are cut at keys sampled from the urls themselves, so a host with many urls is cut by its urls' paths and ids too;
the sample steers only where rows go. A rule whose interval begins before a range is sent to each range that it reaches
into: at any place as many rules are active as are nested there.

Longest is by the whole rule, host and path together; of equally long ones the longer host wins. Of rules that are
repeated with differing verdicts the one that blocks holds. A url that is null or has no `://` has empty host and path,
which no rule fits. Urls that no rule fits get the method's verdict, DEFAULT. Rules without a host fit nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict). Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
#: Above all characters of a key.
TOP = "\U0010ffff"
#: Keys sampled for each range.
SAMPLED = 60


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, in lower case. Path: from there up to `?`, `#` or the end.

    By plain searches, whose depth doesn't grow with the text as a pattern's can.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")

    def until(text: Column, *marks: str) -> Column:
        for mark in marks:
            text = F.substring_index(text, mark, 1)
        return text

    host = until(rest, "/", "?", "#")
    return lower_ascii(host), until(F.substring(rest, F.length(host) + 1, F.length(rest)), "?", "#")


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def cuts(urls: DataFrame, n: int, ranges: int) -> list[tuple[str, str, int]]:
    """Up to ranges - 1 ascending places (key, path, salt) between ranges of about as many of the n urls."""
    picked = urls.filter(common.share_of(F.col("salt"), ranges * SAMPLED / max(n, 1))).select("key", "path", "salt").limit(4 * ranges * SAMPLED).collect()
    places = sorted((r["key"], r["path"], r["salt"]) for r in picked)
    return sorted({places[len(places) * k // ranges] for k in range(1, ranges)}) if places else []


class Paths:
    """The path rules of one host: asked for the longest that begins a path, by as many lookups as there are different lengths."""

    def __init__(self):
        self.verdicts: dict[str, str] = {}
        self.sizes: list[int] = []  # descending

    def add(self, path: str, verdict: str) -> None:
        self.verdicts[path] = verdict
        if len(path) not in self.sizes:
            insort(self.sizes, len(path), key=lambda n: -n)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.sizes if n <= len(path) and path[:n] in self.verdicts), None)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages; rules has columns host, path, verdict."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    host, path = host_and_path(pages[url_col])
    urls = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), pages[url_col].alias("url"))
    urls = urls.select("*", host_key(F.col("host")).alias("key"), F.xxhash64("page_id", "url").alias("salt"))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = cuts(urls, pages.count(), ranges)
    urls = urls.drop("url")

    # Strings compare by UTF-8 bytes everywhere below, which for Python's strings is the order of code points.
    def of_url(key: pa.Array, path: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array([bisect_right(at, x) for x in zip(key.to_pylist(), path.to_pylist(), salt.to_pylist(), strict=True)], pa.int32())

    def of_rule(key: pa.Array) -> pa.Array:
        return pa.array([list(range(bisect_left(at, (k,)), bisect_right(at, (k + TOP,)) + 1)) for k in key.to_pylist()], pa.list_(pa.int32()))

    dealt = urls.withColumn("range", F.arrow_udf(of_url, "int")("key", "path", "salt")).withColumns({"kind": F.lit(1), "verdict": F.lit(None).cast("string")})
    held = rules.select(lower_ascii(F.col("host")).alias("host"), F.col("path"), F.col("verdict")).filter("host != '' and path is not null and verdict is not null")
    held = held.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    held = held.withColumn("key", host_key(F.col("host"))).withColumn("range", F.explode(F.arrow_udf(of_rule, "array<int>")("key")))
    held = held.withColumns({"page_id": F.lit(None).cast(urls.schema["page_id"].dataType), "kind": F.lit(0), "salt": F.lit(0).cast("long")})
    both = dealt.unionByName(held)
    swept = both.repartitionById(len(at) + 1, F.col("range")).sortWithinPartitions("range", "key", "kind").select("page_id", "host", "path", "key", "kind", "range", "verdict")
    kind = urls.schema["page_id"].dataType.simpleString()

    def sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, Paths]] = []  # key, host, its path rules
        now = None
        for batch in parts:
            out = []
            for page, host, path, key, kind, place, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now:
                    stack, now = [], place
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, Paths()))
                    stack[-1][2].add(path, verdict)
                    continue
                best = None
                for _, owner, paths in reversed(stack):
                    begin = paths.longest(path)
                    if begin is not None and (best is None or len(owner) + len(begin) > best[0]):
                        best = (len(owner) + len(begin), owner + begin, paths.verdicts[begin])
                out.append((page, host, path, *((best[1], best[2]) if best else (None, default))))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.string()) for c in cols[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return swept.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def own_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


#: The same by plain SQL, for the rules above.
SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.said,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) AS place
  FROM split s LEFT JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM fitting WHERE place = 1
"""
