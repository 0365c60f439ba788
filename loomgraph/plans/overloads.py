"""Overloads that a call's arguments can mean, as a relation: one row per site, candidate and argument.

How well an argument's type fits a parameter's is looked up: for built-in types in a fixed table, for classes in the
relations of supertypes and of the repository's own classes. A candidate fits as its worst argument does, and candidates of a site
are compared by their lists of fits. Types are canonical: the last segment, with boxed types folded into primitive ones;
an unknown type is null and fits all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Boxed types and the primitives that they are folded into.
BOXED = {"Long": "long", "Integer": "int", "Int": "int", "Short": "short", "Byte": "byte", "Boolean": "boolean", "Character": "char", "Char": "char", "Double": "double", "Float": "float"}
#: Numeric types from the narrowest to the widest; char widens to int and beyond.
NUMBERS = ["byte", "short", "int", "long", "float", "double"]
PRIMITIVES = [*NUMBERS, "char", "boolean"]
#: Types that take all, and the known supertypes of built-in types.
TOP = ["Object", "Any"]
SUPERS = {"number": ["Number", "Comparable", "Serializable"], "other": ["Comparable", "Serializable"], "String": ["CharSequence", "Comparable", "Serializable"]}
#: An integer literal without a suffix, whose type in Kotlin follows what is expected there.
LITERAL = "#int"
CERTAIN, POSSIBLE, NEVER = 2, 1, 0


def canonical(col: Column) -> Column:
    tail = F.regexp_extract(col, "[^.]+$", 0)
    return F.when(col.isNull() | (col == LITERAL), col).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in BOXED.items() for x in kv])[tail], tail))


def builtin_fits(spark: SparkSession) -> DataFrame:
    """(language, arg, param, known): all ways in which a built-in argument type fits a parameter of another type."""
    rows = [(x, "String", s, CERTAIN) for x in ("java", "kotlin") for s in SUPERS["String"]]
    for arg in [*PRIMITIVES, LITERAL]:
        own = "int" if arg == LITERAL else arg
        above = [(s, CERTAIN) for s in SUPERS["number" if own in NUMBERS else "other"]]
        wider = NUMBERS[NUMBERS.index("int" if own == "char" else own) + (own != "char") :] if own != "boolean" else []
        literal = [(p, CERTAIN) for p in ("int", "long", "short", "byte")] if arg == LITERAL else []
        rows += [("java", arg, *x) for x in [*above, *[(p, POSSIBLE) for p in wider], *([(own, CERTAIN)] if arg == LITERAL else [])]]
        rows += [("kotlin", arg, *x) for x in [*above, *literal]]
    return spark.createDataFrame(rows, "language string, arg string, param string, known int")


def fits(pairs: DataFrame, supers: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (language, arg, param) with fit, own (the parameter is one of the repository's classes) and chain (the argument
    extends it); supers (type, above, chain) and classes (type) have canonical names."""
    known = F.broadcast(builtin_fits(pairs.sparkSession))
    s = supers.select(F.col("type").alias("arg"), F.col("above").alias("param"), "chain", F.lit(True).alias("below"))
    rows = pairs.join(known, ["language", "arg", "param"], "left").join(s, ["arg", "param"], "left").join(classes.select(F.col("type").alias("param"), F.lit(True).alias("own")), "param", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    arg, param = F.col("arg"), F.col("param")
    fit = (
        F.when(arg.isNull() | param.isNull() | (arg == param) | param.isin(*TOP), CERTAIN)
        .when(arg.isin(*PRIMITIVES, LITERAL, "String"), F.coalesce("known", F.lit(NEVER)))
        .when(param.isin(*PRIMITIVES, "String"), NEVER)
        .when(yes("below"), CERTAIN)
        .otherwise(F.when(yes("own"), NEVER).otherwise(POSSIBLE))
    )
    return rows.select("language", "arg", "param", fit.alias("fit"), yes("own").alias("own"), yes("chain").alias("chain"))


def slots(cands: DataFrame, sites: DataFrame, shapes: DataFrame) -> DataFrame:
    """(site, grp, target, language, at, arg, param, var, named): each argument of a site beside the parameter that a candidate has for it.

    Named arguments go by name (named is false where no parameter has it); those past the declared ones meet an unknown type.
    """
    args = sites.select("site", "language", "arg_types", "arg_names", F.explode(F.sequence(F.lit(0), F.greatest(F.size("arg_types"), F.size("arg_names")) - 1)).alias("at"))
    args = args.select("site", "language", "at", canonical(F.get("arg_types", F.col("at"))).alias("arg"), F.get("arg_names", F.col("at")).alias("name"))
    rows = cands.select("site", "grp", "target").distinct().join(args, "site").join(shapes, "target")
    place = F.when(F.col("name").isNull(), F.col("at")).otherwise(F.coalesce(F.array_position("param_names", F.col("name")).cast("int"), F.lit(0)) - 1)
    rows = rows.withColumn("place", place)
    inside = F.col("place") >= 0
    return rows.select("site", "grp", "target", "language", "at", "arg", F.when(inside, canonical(F.get("param_types", F.col("place")))).alias("param"), F.when(inside, F.get("param_type_vars", F.col("place"))).alias("var"), inside.alias("named"))


def makes_needless(d: Column, c: Column, worst: Column, language: Column) -> Column:
    """Whether a certain fit d makes c needless; both are lists of (arg, param, fit, own, chain), one item an argument."""
    both = F.arrays_zip(d.alias("d"), c.alias("c"))
    primitive = lambda x: F.coalesce(x.isin(*PRIMITIVES), F.lit(False))
    top = lambda x: F.coalesce(x.isin(*TOP), F.lit(False))

    def nearer(p: Column) -> Column:
        """d surely takes the argument's own type or one between it and what c takes."""
        same = F.coalesce(p["d"]["param"] == p["d"]["arg"], F.lit(False)) & ~((language == "java") & primitive(p["d"]["param"]))
        return (p["c"]["fit"] != POSSIBLE) | (p["d"]["param"].isNotNull() & (same | p["d"]["own"] | p["d"]["chain"]))

    def alike(p: Column) -> Column:
        return F.coalesce(p["d"]["param"] == p["c"]["param"], F.lit(False))

    def narrower(p: Column) -> Column:
        """c takes anything where d takes a type that the known argument surely has."""
        arg, param = p["d"]["arg"], p["d"]["param"]
        unsure = F.when(language == "kotlin", (arg == LITERAL) & (param != "int")).otherwise(primitive(arg) & primitive(param))
        return ~alike(p) & top(p["c"]["param"]) & param.isNotNull() & ~top(param) & arg.isNotNull() & ~F.coalesce(unsure, F.lit(False))

    return F.when(worst == POSSIBLE, F.forall(both, nearer)).otherwise(F.forall(both, lambda p: alike(p) | narrower(p)) & F.exists(both, narrower))


def narrow(cands: DataFrame, sites: DataFrame, shapes: DataFrame, supers: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of cands (site, grp, target, ...) whose targets the site's arguments can mean; all of a group where none can, where nothing is
    known, and where there is one target only.

    sites (site, language, arg_types, arg_names); shapes (target, param_types, param_names, param_type_vars, vararg); for supers
    and classes see fits(). A group is a site's candidates of one rank, as many as one class or file has overloads.
    """
    empty = F.array().cast("array<string>")
    known = sites.select("site", "language", F.coalesce("arg_types", empty).alias("arg_types"), F.coalesce("arg_names", empty).alias("arg_names"))
    known = known.filter(F.exists("arg_types", lambda x: x.isNotNull()) | F.exists("arg_names", lambda x: x.isNotNull()))
    several = cands.groupBy("site", "grp").agg(F.countDistinct("target").alias("n")).filter("n > 1").select("site", "grp")
    hard = cands.join(several, ["site", "grp"], "left_semi").join(known.select("site"), "site", "left_semi")
    canon = lambda df, *cols: df.select(*[canonical(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
    supers = canon(supers, "type", "above").groupBy("type", "above").agg(F.max("chain").alias("chain"))
    rows = cut(slots(hard, known, shapes))
    found = fits(rows.select("language", "arg", "param").distinct(), supers, canon(classes, "type").distinct())
    found = found.select(*[F.col(c).alias(f"_{c}") for c in ("language", "arg", "param")], "fit", "own", "chain")
    rows = rows.join(found, (F.col("language") == F.col("_language")) & F.col("arg").eqNullSafe(F.col("_arg")) & F.col("param").eqNullSafe(F.col("_param")))
    item = F.struct("at", "arg", "param", "fit", "own", "chain")
    one = rows.groupBy("site", "grp", "target", "language").agg(
        F.min(F.when(F.col("named"), F.col("fit")).otherwise(NEVER)).alias("worst"),
        F.array_sort(F.collect_list(item)).alias("items"),
        F.min(F.col("param").isNotNull() | F.coalesce(F.col("var") == "*", F.lit(False))).alias("told"),
        F.min(F.col("arg").isNotNull()).alias("all_args"),
    ).join(shapes.select("target", F.col("vararg")), "target")
    w = Window.partitionBy("site", "grp")
    fixed = (F.col("language") == "java") & F.col("all_args") & ~F.col("vararg") & F.col("told") & (F.col("worst") == CERTAIN)
    one = one.withColumns({"best": F.max("worst").over(w), "fixed": F.max(fixed).over(w), "sure": F.collect_list(F.when(F.col("worst") == CERTAIN, F.struct("target", "items"))).over(w)})
    beaten = F.exists("sure", lambda d: (d["target"] != F.col("target")) & makes_needless(d["items"], F.col("items"), F.col("worst"), F.col("language")))
    keep = (F.col("best") == NEVER) | ((F.col("worst") > NEVER) & ~(F.col("fixed") & F.col("vararg")) & ~beaten)
    gone = one.filter(~F.coalesce(keep, F.lit(True))).select("site", "grp", "target")
    return cands.join(gone, ["site", "grp", "target"], "left_anti").select(cands.columns)
