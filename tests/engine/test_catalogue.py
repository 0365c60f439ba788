import os

import duckdb
import pytest

import __spark_entry__
from loomgraph import catalogue

DATA = "/root/testdata/sf0.001"
CHEAP = ["repo_stats", "edge_buckets", "archetype_classify", "hybrid_search_filtered", "import_edges", "resolve_types", "remove_overridden", "container_floor", "search_pattern_context", "parse_diff", "extract_symbols"]


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"narrow_overloads"} and set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", CHEAP)
def test_twins_agree(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = db.execute(catalogue.SQL[name])
    cols = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_flagship(spark):
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).columns == ["query_id", "place", "id", "kind", "score"]
