"""Tables of the engine as Spark schemas, their fixed domains, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the tables below. A store of an older version is read through the steps of MIGRATIONS.
SCHEMA_VERSION = 2

REPOS = "id string, name string, path string, last_commit string, extractor_version int, indexed_at timestamp, created_at timestamp"
FILES = "id string, repo_id string, path string, language string, content_hash string, package_name string, indexed_at timestamp"
SYMBOLS = (
    "id string, file_id string, name string, qualified_name string, kind string, parent_id string, start_line int, end_line int, "
    "start_offset int, end_offset int, signature string, doc_comment string, visibility string, is_static boolean, is_local boolean, "
    "declared_type string, min_params int, max_params int, param_types array<string>, param_names array<string>, "
    "param_type_vars array<string>, type_params array<string>, extension_receiver string"
)
IMPORTS = "id string, file_id string, import_path string, alias string, is_wildcard boolean"
CALL_SITES = (
    "id string, file_id string, source_symbol_id string, receiver string, receiver_kind string, receiver_type string, "
    "receiver_declared boolean, receiver_site_id string, is_navigation boolean, method_name string, arg_count int, "
    "arg_types array<string>, arg_names array<string>, implicit_receiver_type string, line int"
)
INHERITANCE_REFS = "id string, file_id string, source_symbol_id string, kind string, type_name string, type_args array<string>"
EDGES = "source_id string, target_id string, kind string, line int, resolution string, receiver_class_id string"
CLASS_ANCESTORS = "class_id string, ancestor_id string, depth int"
BODY_NODES = "container_id string, file_id string, hit_kind string, start_line int, end_line int"
VECTORS = "id string, embedding array<float>"
TABLES = {"repos": REPOS, "files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "call_sites": CALL_SITES, "inheritance_refs": INHERITANCE_REFS, "body_nodes": BODY_NODES, "edges": EDGES, "class_ancestors": CLASS_ANCESTORS, "vectors": VECTORS}

#: Fixed domains.
LANGUAGES = {".java": "java", ".kt": "kotlin", ".ts": "typescript", ".tsx": "tsx"}
CONTAINERS = ["class", "interface", "enum", "object"]
CALLABLES = ["method", "function", "constructor"]
EDGE_KINDS = ["calls", "extends", "implements", "imports", "overrides"]


#: By version: columns that it added to tables, with the values of rows from before. Applied in order to what is read.
MIGRATIONS: dict[int, dict[str, dict[str, str]]] = {2: {"repos": {"last_commit": "cast(null as string)", "extractor_version": "1"}}}


def make_id(*parts: Column | str) -> Column:
    """The same id for the same parts, run after run."""
    return F.lower(F.lpad(F.hex(F.xxhash64(*parts)), 16, "0"))
