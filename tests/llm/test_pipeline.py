import numpy as np

import corpus_pipeline
from loomgraph.llm import packing, quality, simhash, toxicity

from .data import labelled, no_docs, odd_rows
from .test_simhash import slow


def test_stages(spark, tmp_path):
    docs, labels, _ = labelled(spark)
    docs = docs.selectExpr("*", "length(text) as n_chars")
    sf_dir = f"file://{tmp_path}/sf"
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf_dir)
        after.write.parquet(f"file://{tmp_path}/{name}")
        after = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept.append((now, after))
        now = after
    (d0, d1), (_, d2), (_, d3), (_, d4) = kept
    rows = lambda df: sorted(map(str, df.collect()))
    model = quality.fit(d0, labels)
    good = {str(r.doc_id) + str(r.score) for r in quality.score(d0, model).collect() if r.predicted}
    assert d1.count() == sum(r.predicted for r in quality.score(d0, model).collect()) and good
    assert d2.count() == sum(1 - r.predicted for r in toxicity.score(d1, toxicity.fit(d1, labels)).collect())
    u = np.array([slow(r.text) for r in d2.collect()], np.uint64)
    near = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    assert d3.count() == len(set(simhash.roots(len(u), *near).tolist())) < len(u)
    assert d1.columns == d2.columns == d3.columns == d0.columns
    assert rows(d4.select("length", "ids_crc32")) == rows(packing.pack(d3).select("length", "ids_crc32"))
    assert corpus_pipeline.run(spark, sf_dir).count() == d4.count()


def test_no_documents(spark, tmp_path):
    sf_dir = f"file://{tmp_path}/none"
    none = no_docs(spark)
    none.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_rows_without_ids_are_kept_once(spark):
    docs = spark.createDataFrame([(None, odd_rows()[3][1]), (None, odd_rows()[3][1]), (4, "wholly other words stand here")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 2
