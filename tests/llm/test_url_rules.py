import random

import duckdb
import pandas as pd

from loomgraph.llm import url_rules

URLS = [
    None, "", "no scheme", "http://Example.NET/en/a", "https://a.example.net/en/", "https://a.example.net/fr/x?y#z", "http://badexample.net/en/", "https://x.org/fr/1", "org://org/fr/", "http://example.com/de/",
    "http://EXAMPLE.com/de?x=/de/", "http://a.b.c.net", "http://net/", "http://.net/", "a://b://c.net/x", "http://example.net:80/en/", "http://org/fr", "http://\nnet/\nx", "http://net/?q#f", "http:///path", "://net/", "http://é.net/", "x" * 5000 + "://net/",
]


def slow(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, *(best[2:] if best else (None, default)))


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' as host", "1 as range", "2 as salt", "'v' as verdict").repartition(3)
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)]


def test_odd_urls(spark):
    assert judged(spark, URLS, url_rules.RULES) == [slow(u, url_rules.RULES) for u in URLS]


def test_sql_agrees(spark, tmp_path):
    pd.DataFrame({"page_id": range(len(URLS)), "url": URLS}).to_parquet(tmp_path / "pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    rows = sorted(db.execute(url_rules.SQL).fetchall())
    assert [r[1:] for r in rows] == [slow(u, url_rules.RULES) for u in URLS]


def test_many_nested_rules_and_a_hot_host(spark):
    rng = random.Random(4)
    labels = ["a", "b", "c", "ab", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(300)] + [f"https://hot.a.net{path()}" for _ in range(300)]
    got = judged(spark, urls, rules)
    for url, x in zip(urls, got, strict=True):
        want = slow(url, rules)
        assert x[:2] == want[:2] and x[3] == want[3] and len(x[2] or "") == len(want[2] or "")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, url_rules.own_rules(spark)).count() == 0
    assert judged(spark, URLS[:4], [(None, "/", "block"), ("", "/", "block")]) == [slow(u, []) for u in URLS[:4]]


def test_long_urls_of_mixed_characters(spark):
    mixed = "a\U0001f600" * 200_000
    urls = [mixed, f"http://{mixed}.net/{mixed}", f"http://h/{mixed}?q", "http://a.example.net" + mixed]
    assert judged(spark, urls, url_rules.RULES) == [slow(u, url_rules.RULES) for u in urls]


def test_a_host_with_many_path_rules():
    paths, rng = url_rules.Paths(), random.Random(3)
    rules = {"/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6))) for _ in range(200)}
    for x in rules:
        paths.add(x, "block")
    assert len(paths.sizes) <= 7
    for _ in range(300):
        path = "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9)))
        assert paths.longest(path) == max((x for x in rules if path.startswith(x)), key=len, default=None)
