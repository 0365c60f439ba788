"""The driver's tables as a symbol graph, and the same relations in SQL.

`part` gives symbols, each order an edge between the parts of its first and last lines, `p_brand` classes in a binary tree,
`documents` files, and part names, words with types and users' turns of `conversations` search queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .reading import lines

#: Fixed values of the binding.
KINDS = {"STANDARD": "class", "PROMO": "interface", "LARGE": "enum", "ECONOMY": "method", "MEDIUM": "function", "SMALL": "property"}
FOLDERS = ["service", "controller", "dto", "repository", "config", "util", "test", "entity", "mapper", "core"]
ENDINGS = ["Service", "Controller", "Request", "Dao", "", "Test", "Builder", "Factory", "Error", "Handler"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(col, values):
    out = F.when(col == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(col == k, v)
    return out


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.lit(False), "")
    for k, v in KINDS.items():
        kind = kind.when(F.col("p_type") == k, v)
    camel = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), _choose(F.col("p_partkey") % 10, ENDINGS))
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    qualified = F.concat_ws(".", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_")))
    path = F.concat(F.lit("src/"), _choose(F.col("p_size") % 10, FOLDERS), F.lit("/"), camel, F.lit(".java"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), camel.alias("type_name"), qualified.alias("qualified_name"), kind.otherwise("unknown").alias("kind"), F.col("p_brand").alias("repo"), brand.alias("parent_id"), path.alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 7).cast("int").alias("end_line"), F.col("p_retailprice").alias("price"))


#: Fixed values of the binding: an edge's kind by its line's flag and status.
FLAGS = {("A", "F"): "calls", ("A", "O"): "calls", ("N", "F"): "calls", ("N", "O"): "overrides", ("R", "F"): "implements", ("R", "O"): "extends"}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each order, from the part of its first line to that of its last, which gives the edge its other columns."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    kind = F.lit(None).cast("string")
    for (flag, status), name in FLAGS.items():
        kind = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), name).otherwise(kind)
    rows = table(spark, sf_dir, "lineitem").withColumns({"source_id": F.first("l_partkey").over(w), "later": F.lead("l_orderkey").over(w), "kind": kind})
    resolution = F.when(F.col("kind") != "calls", F.lit(None)).when(F.col("l_linenumber") % 4 == 1, "super").when(F.col("l_linestatus") == "O", "typed").otherwise("local")
    receiver = F.when(F.col("l_tax") >= 0.04, (F.col("l_suppkey") % 25 + 1).cast("int"))
    return rows.filter("later is null and source_id != l_partkey").select("source_id", F.col("l_partkey").alias("target_id"), "kind", F.col("l_linenumber").alias("line"), resolution.alias("resolution"), receiver.alias("receiver_class_id")).distinct()


def class_ancestors(spark: SparkSession) -> DataFrame:
    """Classes 1 to 25 and their ancestors in a binary tree, themselves included."""
    pairs, k = [], 0
    for c in range(1, 26):
        k = c
        while k:
            pairs.append((c, k))
            k //= 2
    return spark.createDataFrame(pairs, "class_id int, ancestor_id int")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id): orders in customers in nations in regions."""
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    rows = [
        table(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent_id")),
        table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id")),
        table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): part names, their first words with a type, types with a word that is nowhere, and what users say in conversations.

    Ids come from the rows' own keys: no query waits for the others to be numbered.
    """
    p, said = table(spark, sf_dir, "part"), table(spark, sf_dir, "conversations").filter("role = 'user'")
    key = lambda n: (F.min("p_partkey") + n).alias("query_id")
    texts = [
        p.groupBy(F.col("p_name").alias("query")).agg(key(0)),
        p.groupBy(F.concat_ws(" ", F.split("p_name", " ")[0], F.lower("p_type")).alias("query")).agg(key(1_000_000_000)),
        p.groupBy(F.concat_ws(" ", F.lower("p_type"), F.lit("missing")).alias("query")).agg(key(2_000_000_000)),
        said.groupBy(F.col("text").alias("query")).agg((F.min(F.col("conv_id") * 1000 + F.col("turn")) + 3_000_000_000).alias("query_id")),
    ]
    out = texts[0]
    for x in texts[1:]:
        out = out.unionByName(x)
    return out.select("query_id", "query")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, repo, line_no, line): the lines of documents, from 1."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("repo"), "text")
    return lines(d, F.col("text"), "file", "repo")


def _case(col: str, values: list[str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_CAMEL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), '') || " + _case("p_partkey % 10", ENDINGS)
SYMBOLS = f"""sym AS (
  SELECT p_partkey AS id, p_name AS name, {_CAMEL} AS type_name, p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') AS qualified_name,
    CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'unknown' END AS kind, p_brand AS repo,
    CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS parent_id, 'src/' || {_case("p_size % 10", FOLDERS)} || '/' || {_CAMEL} || '.java' AS path,
    p_size AS start_line, CAST(p_size + p_partkey % 7 AS INT) AS end_line, p_retailprice AS price FROM part)"""
EDGES = """edge AS (
  SELECT DISTINCT source_id, target_id, kind, line, CASE WHEN kind <> 'calls' THEN NULL WHEN line % 4 = 1 THEN 'super' WHEN l_linestatus = 'O' THEN 'typed' ELSE 'local' END AS resolution, receiver_class_id FROM (
    SELECT first_value(l_partkey) OVER w AS source_id, l_partkey AS target_id, lead(l_orderkey) OVER w AS later, l_linenumber AS line, l_linestatus,
      CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'calls' WHEN 'AO' THEN 'calls' WHEN 'NF' THEN 'calls' WHEN 'NO' THEN 'overrides' WHEN 'RF' THEN 'implements' WHEN 'RO' THEN 'extends' END AS kind,
      CASE WHEN l_tax >= 0.04 THEN CAST(l_suppkey % 25 + 1 AS INT) END AS receiver_class_id
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount, l_tax, l_shipdate))
  WHERE later IS NULL AND source_id <> target_id)"""
ANCESTORS = """anc AS (
  SELECT c AS class_id, c // k AS ancestor_id FROM range(1, 26) t(c), (VALUES (1), (2), (4), (8), (16)) u(k) WHERE c // k >= 1)"""
TREE = """tree AS (
  SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent_id FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
QUERIES = """qry AS (
  SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY ALL UNION ALL SELECT min(p_partkey) + 1000000000, string_split(p_name, ' ')[1] || ' ' || lower(p_type) AS q FROM part GROUP BY q
  UNION ALL SELECT min(p_partkey) + 2000000000, lower(p_type) || ' missing' AS q FROM part GROUP BY q UNION ALL SELECT min(conv_id * 1000 + turn) + 3000000000, text FROM conversations WHERE role = 'user' GROUP BY text)"""
LINES = """lines AS (
  SELECT doc_id AS file, source AS repo, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""
