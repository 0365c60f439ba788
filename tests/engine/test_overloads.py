import pytest
from pyspark.sql import functions as F

from loomgraph.plans import overloads

SHAPES = "target string, param_types array<string>, param_names array<string>, param_type_vars array<string>, vararg boolean"


@pytest.fixture(scope="module")
def about(spark):
    """Supertypes (Order extends Base and implements Marker) and the repository's classes."""
    return spark.createDataFrame([("Order", "Base", True), ("Order", "Marker", False)], "type string, above string, chain boolean"), spark.createDataFrame([("Order",), ("Base",), ("Line",)], "type string")


def test_canonical(spark):
    texts = ["java.lang.Integer", "Char", "a.B", "String", None, "#int"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(overloads.canonical(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["int", "char", "B", "String", None, "#int"]


def test_fits(spark, about):
    want = [
        ("java", None, "int", 2), ("java", "Order", None, 2), ("kotlin", "Order", "Any", 2), ("java", "int", "Number", 2), ("java", "boolean", "Number", 0), ("kotlin", "#int", "long", 2), ("kotlin", "#int", "double", 0), ("java", "#int", "double", 1),
        ("java", "#int", "short", 0), ("java", "char", "int", 1), ("java", "long", "int", 0), ("kotlin", "int", "long", 0), ("java", "String", "CharSequence", 2), ("java", "String", "List", 0), ("java", "Order", "int", 0), ("java", "Order", "Base", 2),
        ("java", "Order", "Marker", 2), ("java", "Base", "Order", 0), ("java", "Order", "Closeable", 1), ("java", "List", "Base", 0), ("java", "byte", "short", 1), ("java", "double", "float", 0), ("java", "char", "short", 0), ("java", "int", "int", 2), ("java", "#int", "int", 2),
        ("kotlin", "char", "int", 0), ("java", "char", "Comparable", 2), ("kotlin", "boolean", "Serializable", 2),
    ]
    pairs = spark.createDataFrame([x[:3] for x in want], "language string, arg string, param string")
    got = {(r.language, r.arg, r.param): r.fit for r in overloads.fits(pairs, *about).collect()}
    assert got == {x[:3]: x[3] for x in want}


#: Arguments, names, language, candidates (target, types, names, type variables, vararg), and the targets that stay.
CASES = [
    (["Order"], [], "java", [("n", ["long"]), ("o", ["Order"]), ("a", ["Object"])], "o"),
    ([None], [], "java", [("n", ["long"]), ("o", ["Order"])], "no"),
    (["boolean"], [], "java", [("n", ["long"]), ("o", ["Order"])], "no"),
    (["#int"], [], "kotlin", [("n", ["long"]), ("a", ["Object"])], "na"),
    (["#int"], [], "kotlin", [("n", ["int"]), ("a", ["Object"])], "n"),
    (["int"], [], "java", [("v", ["int"], None, None, True), ("f", ["int"])], "f"),
    (["int"], [], "java", [("v", ["int"], None, None, True), ("f", [None])], "vf"),
    (["int"], [], "java", [("v", ["int"], None, None, True), ("f", [None], None, ["*"])], "f"),
    (["int"], [], "kotlin", [("v", ["int"], None, None, True), ("f", ["int"])], "vf"),
    ([None], ["order"], "kotlin", [("n", ["long"], ["id"]), ("o", ["Order"], ["order"])], "o"),
    (["Order"], [], "java", [("c", ["Closeable"]), ("b", ["Base"])], "b"),
    (["Order"], [], "java", [("c", ["Closeable"]), ("m", ["Marker"])], "cm"),
    (["Foo", None], [], "java", [("f", ["Foo", None]), ("o", ["Object", None])], "fo"),
    (["Foo", "String"], [], "java", [("f", ["Foo", "String"]), ("o", ["Object", "String"])], "f"),
    (["int"], [], "java", [("i", ["int"]), ("o", ["Object"])], "io"),
    (["int"], [], "java", [("l", ["long"]), ("d", ["double"])], "ld"),
    (["Order"], [], "java", [("s", ["String"])], "s"),
    (["java.lang.String", "Order"], [], "java", [("a", ["String", "Order"]), ("b", ["String", "Line"])], "a"),
]


def test_narrow(spark, about):
    sites, cands, shapes = [], [], []
    for k, (args, names, language, given, _) in enumerate(CASES):
        sites.append((k, language, args, names or None))
        for target, types, *more in given:
            more = [*more, None, None, None][:3]
            cands.append((k, 1, f"{k}{target}", "local"))
            shapes.append((f"{k}{target}", types, more[0], more[1], bool(more[2])))
    got = overloads.narrow(spark.createDataFrame(cands, "site int, grp int, target string, resolution string"), spark.createDataFrame(sites, "site int, language string, arg_types array<string>, arg_names array<string>"), spark.createDataFrame(shapes, SHAPES), *about).collect()
    for k, case in enumerate(CASES):
        assert {r.target for r in got if r.site == k} == {f"{k}{t}" for t in case[-1]}, case
    assert got[0].asDict().keys() == {"site", "grp", "target", "resolution"}
