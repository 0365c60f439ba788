from pyspark.sql import functions as F

from loomgraph.functions import paths, symbols
from loomgraph.sources import diffs

def test_globs_and_paths():
    assert paths.glob_to_like("src/**/*.java") == "src/%.java" and paths.glob_to_like("a_b%?") == "a\\_b\\%_"
    assert paths.safe_path("/r", "a/../b") == "/r/b" and paths.safe_path("/r", "../r2/x") is None and paths.safe_path("/r", ".") is None and paths.safe_path("/r", "a\0") is None


DIFF = """diff --git a/one b/one
--- a/one
+++ b/one
@@ -3,0 +4,2 @@ head
+--- a/not a header
+x
@@ -9,2 +11,0 @@
-x
-y
diff --git "a/d\\303\\251" "b/d\\303\\251"
--- /dev/null
+++ "b/d\\303\\251"
@@ -0,0 +1 @@
+z
diff --git a/gone b/gone
--- a/gone\t
+++ /dev/null
@@ -1,3 +0,0 @@
-a
"""


def test_diffs():
    assert list(diffs.parse(DIFF)) == [
        ("head", "one", "one", 4, 5, 2, 0, 4, 5), ("base", "one", "one", 4, 3, 2, 0, 4, 5), ("head", "one", "one", 9, 10, 0, 2, 11, 10), ("base", "one", "one", 9, 10, 0, 2, 11, 10),
        ("head", "dé", "dé", 1, 1, 1, 0, 1, 1), ("head", "gone", None, 1, 3, 0, 3, 0, -1), ("base", "gone", None, 1, 3, 0, 3, 0, -1),
    ]


def test_columns(spark):
    rows = [("OrderServiceTest", "a.OrderServiceTest", "src/main/OrderServiceTest.java", "class"), ("find", "a.OrderDao.find", "src/main/OrderDao.java", "method"), ("X", "a.X", "src/main/rest/X.java", "class"), ("X", "a.X", "m/test/X.java", "class"), ("X", "X", "test/X.java", "class")]
    df = spark.createDataFrame(rows, "name string, qn string, path string, kind string")
    got = [r[0] for r in df.select(symbols.archetype(F.col("name"), F.col("qn"), F.col("path"), F.col("kind"))).collect()]
    assert got == ["test", "repository", "controller", "test", "other"]
    scores = spark.createDataFrame([(1, "calls"), (2, "extends"), (1, "overrides"), (9, "calls")], "d int, k string").select(symbols.confidence(F.col("d"), F.col("k"))).collect()
    assert [r[0] for r in scores] == [1.0, 0.9, 1.0, 0.1]


def test_quoted_paths():
    assert diffs.unquoted('"a\\303\\251 \\"b\\" \\\\ \\t"') == 'aé "b" \\ \t'
    assert diffs.unquoted('"x\\8\\9\\q"') == "x\\8\\9\\q" and diffs.unquoted('"') == '"' and diffs.unquoted("a b\tdate") == "a b"
    renamed = "diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\ndiff --git a/p b/q\nBinary files a/p and b/q differ\n"
    assert list(diffs.parse(renamed)) == [] == list(diffs.parse(""))


def test_commits_and_paths_in_messages():
    assert paths.short_commit("a" * 40) == "a" * 12 and paths.short_commit("HEAD") == "HEAD" and paths.short_commit(None) is None
    assert paths.redact("at /r/x", "/r") == "at <repo>/x"
