import numpy as np

from loomgraph.llm import common, components, simhash


def test_hubs_chains_and_apart_sets(spark):
    rng = np.random.default_rng(3)
    edges = [(0, k) for k in range(1, 900)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (2000, 2001), (2001, 2000)]
    edges += [(3000 + int(a), 3000 + int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(3), "test").collect()}
    a, b = np.array(edges).T
    want = simhash.roots(4000, a, b)
    assert all(want[u] == got.get(u, u) for u in range(4000))


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 3 and 7, k) for k in range(900)] + [(100 + k, k) for k in range(50)], "u long, x long")
    counted = rows.groupBy("u").count().withColumnRenamed("count", "n")
    hot = common.hot_keys(counted, "u", 950)
    facts = counted.selectExpr("u", "u * 2 as twice")
    assert {r.u for r in hot.collect()} == {0, 7}
    assert sorted(common.join_hot(rows, facts, hot, "u").collect()) == sorted(rows.join(facts, "u").select("u", "x", "twice").collect())
