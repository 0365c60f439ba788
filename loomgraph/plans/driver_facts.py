"""The driver's tables as fact tables of three repositories: customers give files with a class each, orders methods, lineitem call sites, suppliers
top-level functions. The bindings are SQL that both Spark and the oracle can run; only what resolves them differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import cut

FILES = """SELECT 'f' || CAST(c_custkey AS STRING) AS id, 'r' || CAST(c_nationkey % 3 AS STRING) AS repo_id,
  'src/' || lower(c_mktsegment) || '/C' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN '.kt' ELSE '.java' END AS path,
  CASE WHEN c_custkey % 4 = 0 THEN 'kotlin' ELSE 'java' END AS language, CASE WHEN c_custkey % 50 <> 0 THEN lower(c_mktsegment) END AS package_name, c_custkey AS k FROM {customer}"""

CLASSES = """SELECT 'c' || CAST(k AS STRING) AS id, id AS file_id, 'T' || CAST(k % 400 AS STRING) AS name, coalesce(package_name || '.', '') || 'T' || CAST(k % 400 AS STRING) AS qualified_name,
  CASE WHEN k % 5 = 0 THEN 'interface' WHEN k % 5 = 1 THEN 'enum' ELSE 'class' END AS kind, CAST(NULL AS STRING) AS parent_id, k FROM {files}"""

NESTED = """SELECT 'n' || CAST(k AS STRING) AS id, file_id, 'T' || CAST((k * 3) % 400 AS STRING) AS name, qualified_name || '.T' || CAST((k * 3) % 400 AS STRING) AS qualified_name, 'class' AS kind, id AS parent_id, k
  FROM {classes} WHERE k % 6 = 0"""

METHODS = """SELECT 'm' || CAST(o_orderkey AS STRING) AS id, c.file_id, 'go' || CAST(o_orderkey % 7 AS STRING) AS name, c.qualified_name || '.go' || CAST(o_orderkey % 7 AS STRING) AS qualified_name, 'method' AS kind, c.id AS parent_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'private' ELSE 'public' END AS visibility, o_orderkey % 17 = 0 AS is_static, CAST(o_orderkey % 3 AS INT) AS min_params, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 3 AS INT) END AS max_params,
  CASE WHEN o_orderkey % 5 = 1 THEN 'Int' WHEN o_orderkey % 5 = 2 THEN 'java.lang.Integer' WHEN o_orderkey % 5 = 3 THEN 'Any' WHEN o_orderkey % 5 = 4 THEN 'Object' END AS p1, 'T' || CAST(o_orderkey % 2 AS STRING) AS p2,
  CASE WHEN o_orderkey % 23 = 0 THEN 'String' END AS extension_receiver, 'T' || CAST(o_orderkey % 400 AS STRING) AS declared_type
  FROM {orders} JOIN {classes} c ON c.k = o_custkey"""

FUNCTIONS = """SELECT 'u' || CAST(s_suppkey AS STRING) AS id, f.id AS file_id, 'go' || CAST(s_suppkey % 7 AS STRING) AS name, coalesce(f.package_name || '.', '') || 'go' || CAST(s_suppkey % 7 AS STRING) AS qualified_name, 'function' AS kind,
  CASE WHEN s_suppkey % 5 = 0 THEN 'private' END AS visibility, CAST(s_suppkey % 3 AS INT) AS min_params, CAST(s_suppkey % 3 AS INT) AS max_params FROM {supplier} JOIN {files} f ON f.k = s_suppkey"""

REFS = """SELECT 'i' || CAST(k AS STRING) AS id, file_id, id AS source_symbol_id, CASE WHEN k % 2 = 0 THEN 'implements' ELSE 'extends' END AS kind,
  CASE WHEN k % 7 = 0 THEN 'building.T' || CAST((k + 1) % 400 AS STRING) ELSE 'T' || CAST((k * 7 + 1) % 400 AS STRING) END AS type_name FROM {classes} WHERE k % 3 <> 0"""

IMPORTS = """SELECT 'x' || CAST(k AS STRING) AS id, id AS file_id, CASE WHEN k % 11 = 0 THEN 'out.side' WHEN k % 4 = 0 THEN 'machinery' ELSE 'building' END || '.T' || CAST((k * 7 + 1) % 400 AS STRING) AS import_path, CAST(NULL AS STRING) AS alias, 1 = 0 AS is_wildcard FROM {files} WHERE k % 2 = 0
  UNION ALL SELECT 'w' || CAST(k AS STRING), id, CASE WHEN k % 2 = 0 THEN 'furniture' ELSE 'household' END, NULL, 1 = 1 FROM {files} WHERE k % 3 = 1"""

SITES = """SELECT 's' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS id, m.file_id, m.id AS source_symbol_id, CASE WHEN flag = 'A' THEN 'x' END AS receiver,
  CASE WHEN flag = 'A' THEN 'identifier' WHEN flag = 'N' THEN 'none' WHEN sk % 2 = 0 THEN 'this' ELSE 'super' END AS receiver_kind, CASE WHEN flag = 'A' THEN 'T' || CAST((pk * 3) % 400 AS STRING) END AS receiver_type,
  'go' || CAST(pk % 7 AS STRING) AS method_name, CASE WHEN pk % 10 <> 0 THEN CAST(pk % 3 AS INT) END AS arg_count, CAST(l_linenumber AS INT) AS line
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_returnflag) AS flag FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l JOIN {methods} m ON m.id = 'm' || CAST(l_orderkey AS STRING)"""

_BOUND = {"files": FILES, "classes": CLASSES, "nested": NESTED, "methods": METHODS, "functions": FUNCTIONS, "refs": REFS, "imports": IMPORTS, "sites": SITES}
_USES = {"files": ["customer"], "classes": ["files"], "nested": ["classes"], "methods": ["orders", "classes"], "functions": ["supplier", "files"], "refs": ["classes"], "imports": ["files"], "sites": ["lineitem", "methods"]}


def view(*names: str) -> tuple[str, ...]:
    """The bindings, and those that they need, as common table expressions for the oracle."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for x in _USES.get(name, []):
            add(x)
        if name in _BOUND and name not in out:
            out[name] = f"{name} AS ({_BOUND[name].format(**{x: x for x in _USES[name]})})"

    for name in names:
        add(name)
    return tuple(out.values())


def _rows(df: DataFrame, table: str, **more) -> DataFrame:
    """df with exactly the columns of a fact table; those that it lacks are null."""
    kinds = dict(c.split(" ", 1) for c in schema.TABLES[table].split(", "))
    df = df.withColumns(more) if more else df
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def bound(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """symbols, files, imports, call_sites and inheritance_refs, not computed yet: plans that read them a few times make only what they need."""
    made: dict[str, DataFrame] = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("customer", "orders", "supplier", "lineitem")}
    for name, sql in _BOUND.items():
        made[name] = spark.sql(sql, **{x: made[x] for x in _USES[name]})
    local = {"is_local": F.lit(False)}
    types = F.when(F.col("max_params").isNotNull(), F.slice(F.array("p1", "p2"), 1, F.col("min_params")))
    symbols = [_rows(made["classes"], "symbols", is_static=F.lit(False), **local), _rows(made["nested"], "symbols", is_static=F.lit(False), **local), _rows(made["methods"], "symbols", param_types=types, **local), _rows(made["functions"], "symbols", is_static=F.lit(False), **local)]
    every = symbols[0]
    for x in symbols[1:]:
        every = every.unionByName(x)
    sites = _rows(made["sites"], "call_sites", is_navigation=F.lit(False), receiver_declared=F.lit(True))
    return {"symbols": every, "files": _rows(made["files"], "files"), "imports": _rows(made["imports"], "imports"), "call_sites": sites, "inheritance_refs": _rows(made["refs"], "inheritance_refs")}


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """bound(), computed once."""
    return {name: df if name == "call_sites" else cut(df) for name, df in bound(spark, sf_dir).items()}  # sites are read once at most, the others many times


# The resolver's rules once more, as the oracle's SQL.

SYMBOLS = """symb AS (
  SELECT id, file_id, name, qualified_name, kind, parent_id FROM classes UNION ALL SELECT id, file_id, name, qualified_name, kind, parent_id FROM nested
  UNION ALL SELECT id, file_id, name, qualified_name, kind, parent_id FROM methods UNION ALL SELECT id, file_id, name, qualified_name, kind, NULL FROM functions),
types AS (SELECT s.*, f.repo_id, f.path, coalesce(f.package_name, '') AS package FROM symb s JOIN files f ON f.id = s.file_id WHERE s.kind IN ('class', 'interface', 'enum'))"""


def resolved(name: str, wanted: str, above: str) -> str:
    """name (ref, class_id): what wanted (ref, file_id, scope_id, type_name) mean; above (class_id, ancestor_id, depth) is reflexive."""
    return f"""{name}_r AS (SELECT w.*, f.repo_id, coalesce(f.package_name, '') AS package, split_part(type_name, '.', 1) AS head, substr(type_name, length(split_part(type_name, '.', 1)) + 1) AS tail FROM ({wanted}) w JOIN files f ON f.id = w.file_id),
{name}_around AS (
  SELECT DISTINCT scope_id, t.id AS enclosing, 0 AS grp FROM {name}_r JOIN types t ON t.id = scope_id
  UNION SELECT scope_id, t.id, 1 FROM {name}_r JOIN symb s ON s.id = scope_id JOIN types t ON t.id = s.parent_id
  UNION SELECT scope_id, t.id, 2 FROM {name}_r JOIN symb s ON s.id = scope_id JOIN symb p ON p.id = s.parent_id JOIN types t ON t.id = p.parent_id),
{name}_claims AS (
  SELECT ref, 0 AS prio, grp, u.depth, t.qualified_name AS found, tail FROM {name}_r JOIN {name}_around USING (scope_id) JOIN {above} u ON u.class_id = enclosing JOIN types t ON t.parent_id = u.ancestor_id AND t.name = head
  UNION ALL SELECT ref, 0, grp, 0, t.qualified_name, tail FROM {name}_r JOIN {name}_around USING (scope_id) JOIN types t ON t.id = enclosing AND t.name = head
  UNION ALL SELECT ref, 1, 0, 0, i.import_path, tail FROM {name}_r r JOIN imports i ON i.file_id = r.file_id AND NOT i.is_wildcard AND coalesce(i.alias, regexp_extract(i.import_path, '[^.]+$')) = head
  UNION ALL SELECT ref, 2, 0, 0, t.qualified_name, tail FROM {name}_r r JOIN types t ON t.repo_id = r.repo_id AND t.package = r.package AND t.name = head AND t.parent_id IS NULL
  UNION ALL SELECT ref, 3, 0, 0, t.qualified_name, tail FROM {name}_r r JOIN imports i ON i.file_id = r.file_id AND i.is_wildcard JOIN types t ON t.repo_id = r.repo_id AND t.package = i.import_path AND t.name = head AND t.parent_id IS NULL
  UNION ALL SELECT ref, 4, 0, 0, type_name, '' FROM {name}_r r WHERE tail <> '' AND EXISTS (SELECT 1 FROM types t WHERE t.repo_id = r.repo_id AND t.qualified_name = type_name)),
{name}_head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY prio, grp, depth, found) AS place FROM {name}_claims) WHERE place = 1),
{name} AS (SELECT ref, class_id FROM (
  SELECT h.ref, t.id AS class_id, row_number() OVER (PARTITION BY h.ref ORDER BY CAST(t.file_id = r.file_id AS INT) DESC, t.path, t.id) AS place
  FROM {name}_head h JOIN {name}_r r USING (ref) JOIN types t ON t.repo_id = r.repo_id AND t.qualified_name = h.found || h.tail) WHERE place = 1)"""


ALONE = "alone AS (SELECT id AS class_id, id AS ancestor_id, 0 AS depth FROM types)"
INHERITED = resolved("inh", "SELECT id AS ref, file_id, source_symbol_id AS scope_id, type_name FROM refs", "alone") + """,
inherited AS (SELECT DISTINCT r.source_symbol_id AS source_id, i.class_id AS target_id, r.kind FROM refs r JOIN inh i ON i.ref = r.id WHERE r.source_symbol_id <> i.class_id)"""
ABOVE = """walk_up AS (
  SELECT id AS class_id, id AS ancestor_id, 0 AS depth FROM types UNION SELECT w.class_id, i.target_id, w.depth + 1 FROM walk_up w JOIN inherited i ON i.source_id = w.ancestor_id WHERE w.depth < 10),
above AS (SELECT class_id, ancestor_id, min(depth) AS depth FROM walk_up GROUP BY ALL)"""
HIERARCHY = (*view("files", "classes", "nested", "methods", "functions", "refs", "imports"), SYMBOLS, ALONE, INHERITED, ABOVE)

_FOLD = "CASE {0} WHEN 'Int' THEN 'int' WHEN 'java.lang.Integer' THEN 'int' WHEN 'Any' THEN 'Object' ELSE {0} END"
_TYPES_FIT = " AND ".join(f"(a.min_params < {k} OR a.p{k} IS NULL OR b.p{k} IS NULL OR {_FOLD.format(f'a.p{k}')} = {_FOLD.format(f'b.p{k}')})" for k in (1, 2))
OVERRIDES = f"""over AS (
  SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM above u JOIN methods a ON a.parent_id = u.class_id JOIN methods b ON b.parent_id = u.ancestor_id AND b.name = a.name
  WHERE u.depth > 0 AND u.class_id <> u.ancestor_id AND NOT a.is_static AND NOT b.is_static AND a.visibility <> 'private' AND b.visibility <> 'private' AND a.extension_receiver IS NOT DISTINCT FROM b.extension_receiver
    AND CASE WHEN a.max_params IS NOT NULL AND b.max_params IS NOT NULL THEN a.min_params = b.min_params AND {_TYPES_FIT} ELSE a.min_params = b.min_params AND a.max_params IS NOT DISTINCT FROM b.max_params END)"""

_TOP = "split_part(substr({0}, length(s.package) + CASE WHEN s.package = '' THEN 1 ELSE 2 END), '.', 1)"
CALLS = resolved("recv", "SELECT id AS ref, file_id, source_symbol_id AS scope_id, receiver_type AS type_name FROM sites WHERE receiver_type IS NOT NULL", "above") + f""",
site AS (SELECT s.id AS site, s.file_id, s.source_symbol_id, s.receiver_kind, s.receiver_type, s.method_name, s.arg_count, s.line, f.repo_id, f.language, coalesce(f.package_name, '') AS package, m.parent_id AS caller_class, m.qualified_name AS caller_qn
  FROM sites s JOIN files f ON f.id = s.file_id JOIN methods m ON m.id = s.source_symbol_id),
starts AS (
  SELECT r.ref AS site, 1 AS grp, r.class_id, 'typed' AS resolution FROM recv r
  UNION ALL SELECT site, 1, caller_class, 'local' FROM site WHERE receiver_kind IN ('none', 'this')
  UNION ALL SELECT site, CASE kind WHEN 'extends' THEN 1 ELSE 2 END, target_id, 'super' FROM site JOIN inherited ON source_id = caller_class WHERE receiver_kind = 'super' AND (kind = 'extends' OR language = 'kotlin')),
member AS (
  SELECT DISTINCT st.site, st.grp, c.id AS target, c.parent_id AS owner, st.class_id AS start_class
  FROM starts st JOIN site s USING (site) JOIN above u ON u.class_id = st.class_id JOIN methods c ON c.parent_id = u.ancestor_id AND c.name = s.method_name
  WHERE (s.arg_count IS NULL OR s.arg_count >= c.min_params AND (c.max_params IS NULL OR s.arg_count <= c.max_params))
    AND (c.visibility <> 'private' OR c.file_id = s.file_id AND {_TOP.format('c.qualified_name')} = {_TOP.format('s.caller_qn')}))"""
FREE = """free AS (
  SELECT s.site, f.id AS target, f.file_id AS owner, CASE WHEN i.file_id IS NULL THEN 101 ELSE 102 END AS grp, f.file_id = s.file_id AS own
  FROM site s JOIN (SELECT u.*, x.repo_id, coalesce(x.package_name, '') AS package FROM functions u JOIN files x ON x.id = u.file_id) f ON f.repo_id = s.repo_id AND f.name = s.method_name
    LEFT JOIN imports i ON i.is_wildcard AND i.file_id = s.file_id AND i.import_path = f.package
  WHERE s.receiver_kind = 'none' AND NOT EXISTS (SELECT 1 FROM member m WHERE m.site = s.site) AND (f.package = s.package OR i.file_id IS NOT NULL)
    AND (s.arg_count IS NULL OR s.arg_count = f.min_params) AND (f.visibility IS NULL OR f.file_id = s.file_id)),
free2 AS (SELECT site, target, owner, CASE WHEN EXISTS (SELECT 1 FROM site s JOIN files x ON x.id = owner WHERE s.site = free.site AND coalesce(x.package_name, '') = s.package) THEN 101 ELSE grp END AS grp, own FROM free),
func AS (SELECT DISTINCT f.site, p.grp, f.target FROM free2 f JOIN (SELECT site, owner, grp FROM (SELECT site, owner, grp, row_number() OVER (PARTITION BY site ORDER BY grp, CAST(own AS INT) DESC, owner, target) AS place FROM free2) WHERE place = 1) p USING (site, owner))"""
EDGES = """lowest AS (SELECT * FROM member a WHERE NOT EXISTS (SELECT 1 FROM member b JOIN over o ON o.source_id = b.target AND o.target_id = a.target WHERE b.site = a.site AND b.grp = a.grp AND b.target <> a.target)),
cand AS (
  SELECT DISTINCT l.site, l.target, l.start_class, st.resolution FROM lowest l JOIN starts st ON st.site = l.site AND st.grp = l.grp AND st.class_id = l.start_class
  UNION ALL SELECT site, target, NULL, 'local' FROM func),
called AS (SELECT c.*, s.source_symbol_id AS source_id, s.line FROM cand c JOIN site s USING (site) WHERE s.source_symbol_id <> c.target)"""
