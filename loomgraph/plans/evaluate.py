"""Found callers against an oracle's: signatures as an IDE prints them, overloads that they mean, precision and recall."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import keep_least
from .overloads import canonical

SIGNATURE = "name string, params array<string>"


def signature_parts(text: str) -> tuple[str, list[str | None] | None]:
    """(method name, parameter types) of `Class.name(Type, Type)`; the types are null without a parameter list.

    The list is the last group in parentheses, since a quoted name may hold some itself. The class before the name is a path without
    spaces: the name begins after the last dot before the first space, or at a backtick. Generics and question marks
    are dropped from types; one that is no path (a function, an array, a vararg) is null.
    """
    spans, stack = [], []
    for k, c in enumerate(text):
        if c == "(":
            stack.append(k)
        elif c == ")" and stack:
            spans.append((stack.pop(), k))
    last = text.rfind(")")
    begin = next((a for a, b in spans if b == last), None)
    head = text if begin is None else text[:begin]
    if "`" in head:
        name = head[head.index("`") :]
    else:
        path = re.split(r"\s", head, maxsplit=1)[0]
        name = head[path.rfind(".") + 1 :]
    if begin is None:
        return name, None
    inside = re.sub(r"->", "  ", text[begin + 1 : last])  # an arrow closes nothing
    depth, parts = 0, [""]
    for c in inside:
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    parts = parts if len(parts) > 1 or parts[0].strip() else []
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    types = []
    for part in parts:
        bare = part
        while (fewer := re.sub(r"<[^<>]*>", "", bare)) != bare:
            bare = fewer
        bare = re.sub(r"[?\s]", "", bare)
        types.append(bare if "  " not in part and re.fullmatch(r"[^\W\d]\w*(\.[^\W\d]\w*)*", bare) else None)
    return name, types


def signature(text: Column) -> Column:
    """SIGNATURE of texts, with canonical types; null for null."""

    @F.arrow_udf("struct<name:string,params:array<string>>")
    def each(texts: pa.Array) -> pa.Array:
        found = [None if t is None else signature_parts(t) for t in texts.to_pylist()]
        return pa.array([None if x is None else {"name": x[0], "params": x[1]} for x in found], pa.struct([("name", pa.string()), ("params", pa.list_(pa.string()))]))

    got = each(text)
    return F.when(text.isNotNull(), F.struct(F.translate(got["name"], "`", "").alias("name"), F.transform(got["params"], canonical).alias("params")))


def declared_params(least: Column, most: Column) -> Column:
    """How many parameters a declaration has: its upper bound, or the required ones and a vararg."""
    return F.coalesce(most, least + 1)


def types_match(want: Column, have: Column) -> Column:
    """Of one length, and equal wherever both are known."""
    alike = F.forall(F.zip_with(want, have, lambda a, b: a.isNull() | b.isNull() | (a == b)), lambda x: x)
    return F.coalesce((F.size(want) == F.size(have)) & alike, F.lit(False))


def oracle_symbols(oracle: DataFrame, symbols: DataFrame) -> DataFrame:
    """(entry, id): the symbols that entries (entry, qualified_name, signature, file) of an oracle mean.

    Of several overloads those of the entry's file stay, then those with as many parameters, then those with its types; a step that would
    leave none is passed over. What is still several is scored as one.
    """
    s = symbols.select("id", "qualified_name", "path", declared_params(F.col("min_params"), F.col("max_params")).alias("declared"), F.transform("param_types", canonical).alias("have"))
    rows = oracle.select("entry", "qualified_name", "file", signature(F.col("signature")).alias("sig")).join(s, "qualified_name")
    tests = [F.col("path").eqNullSafe(F.col("file")), F.col("declared").eqNullSafe(F.size("sig.params")), types_match(F.col("sig.params"), F.col("have"))]
    for test in tests:
        rows = keep_least(rows.withColumn("_miss", F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1)), ["entry"], "_miss").drop("_miss")
    return rows.select("entry", "id").distinct()


def caller_report(oracle: DataFrame, callers: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """(entry, tests, tp, found, expected, precision, recall) for all callers (tests = true) and for those outside tests.

    oracle (entry, qualified_name, signature, file); callers (entry, signature, file): only those with a parameter list count, since other
    places have no symbol; symbols have path, name, param_types, bounds and archetype; reached: impact() rows of depth one with
    the oracle's symbols as seeds. A caller is known by its file and its name without backticks.
    """
    meant = oracle_symbols(oracle, symbols)
    who = symbols.select("id", "path", F.translate("name", "`", "").alias("name"), (F.col("archetype") == "test").alias("test"))
    found = reached.filter("depth = 1 and edge_kind != 'overrides'").join(meant.select("entry", F.col("id").alias("seed")), "seed").join(who, "id").groupBy("entry", "path", "name").agg(F.max("test").alias("test"))
    listed = callers.filter(F.contains("signature", F.lit("("))).select("entry", F.col("file").alias("path"), signature(F.col("signature"))["name"].alias("name")).distinct()
    in_tests = who.groupBy("path").agg(F.max("test").alias("test_file"))
    key = ["entry", "path", "name"]
    rows = found.withColumn("f", F.lit(1)).join(listed.withColumn("o", F.lit(1)), key, "full").join(in_tests, "path", "left").withColumn("test", F.coalesce("test", "test_file", F.lit(False)))
    rows = rows.withColumn("tests", F.explode(F.when(F.col("test"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    n = rows.groupBy("entry", "tests").agg(F.count(F.when(F.col("f").isNotNull() & F.col("o").isNotNull(), 1)).alias("tp"), F.count("f").alias("found"), F.count("o").alias("expected"))
    return n.select("entry", "tests", "tp", "found", "expected", _ratio("found").alias("precision"), _ratio("expected").alias("recall"))


def _ratio(of: str) -> Column:
    return F.round(F.when(F.col(of) > 0, F.col("tp") / F.col(of)), 6)


def precision_recall(found: DataFrame, oracle: DataFrame) -> DataFrame:
    """One row (tp, found, expected, precision, recall); ratios are null where nothing was found or expected."""
    a = found.select("symbol", "caller").distinct().withColumn("f", F.lit(1))
    b = oracle.select("symbol", "caller").distinct().withColumn("o", F.lit(1))
    n = a.join(b, ["symbol", "caller"], "full").agg(F.count(F.when(F.col("f").isNotNull() & F.col("o").isNotNull(), 1)).alias("tp"), F.count("f").alias("found"), F.count("o").alias("expected"))
    return n.select("tp", "found", "expected", _ratio("found").alias("precision"), _ratio("expected").alias("recall"))
