import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import quality, toxicity

from .data import labelled, no_docs, odd_docs


def remainder(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus if doc is not None else -1


@pytest.mark.parametrize(("module", "label", "modulus", "held"), [(quality, 1, 3, 1), (toxicity, 2, 4, 2)])
def test_held_out_accuracy(spark, module, label, modulus, held):
    docs, labels, table = labelled(spark)
    rows = module.score(docs, module.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, modulus) == held) for r in rows)
    assert all(r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    truth = {row[0]: row[label] for row in table}
    hits = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth and r.doc_id not in (0, 1)]
    assert len(hits) > 50 and np.mean(hits) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_and_other_columns_are_not_read(spark, module):
    docs, labels, _ = labelled(spark)
    one = module.fit(docs, labels)
    modulus, held = (3, 1) if module is quality else (4, 2)
    flipped = labels.selectExpr("doc_id", *[f"if(crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {held}, 1 - {c}, {c}) as {c}" for c in ("quality", "toxic")])
    other = module.fit(docs.selectExpr("doc_id", "text", "'q' as lang", "cast(doc_id as string) as source"), flipped)
    texts = pa.array(["ab the on", "", "vermin on the tion***"])
    assert (module.scores(texts, one) == module.scores(texts, other)).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_and_empty_tables(spark, module):
    docs, labels, _ = labelled(spark)
    model = module.fit(docs, labels)
    odd = odd_docs(spark)
    assert module.score(odd, model).count() == odd.count()
    kept = module.keep(odd, model)
    assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()
    assert module.score(no_docs(spark), model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert set(module.scores(pa.array(["a", "", "b c"]), none)) == {0.5}


def test_tables_and_pairs_explain_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.learn(x, y)
    assert {(i, j) for i, j, *_ in model.pairs[:1]} == {(0, 1)}
    assert ((quality.scores_of(x, model) > 0.5) == y).mean() > 0.9


def test_word_features_of_a_batch_do_not_depend_on_the_batch():
    texts = ["ab tion the vermin", "", "wretch on re", "ab ab ab"]
    doc, feature = toxicity.features(pa.array(texts))
    for k, text in enumerate(texts):
        _, alone = toxicity.features(pa.array([text]))
        assert (feature[doc == k] == alone).all()
    rows = quality.featurise(pa.array(texts))
    for k, text in enumerate(texts):
        assert np.allclose(rows[k], quality.featurise(pa.array([text]))[0])


def test_features_against_plain_python():
    from .data import odd_rows

    texts = [t or "" for _, t, *_ in odd_rows()] + ["a | b!\n\na | b!\nTHE  end.", "\n", "é1"]
    for text, got in zip(texts, quality.featurise(pa.array(texts)), strict=True):
        raw, words, lines = text.encode(), text.encode().split(), text.split("\n")
        low = [w.lower() for w in words]
        n, size = max(1, len(words)), max(1, len(raw))
        pairs = list(zip(low[:-1], low[1:], strict=True))
        want = {
            "log_words": np.log1p(len(words)), "digits": sum(48 <= c < 58 for c in raw) / size, "upper": sum(65 <= c < 91 for c in raw) / max(1, sum(65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in raw)), "non_ascii": sum(c >= 128 for c in raw) / size, "bars": raw.count(b"|") / n, "words_a_line": len(words) / len(lines),
            "distinct_words": len(set(low)) / n, "top_word": max(map(low.count, set(low)), default=0) / n, "repeats": sum(a == b for a, b in pairs) / n, "distinct_pairs": len(set(pairs)) / max(1, len(words) - 1), "duplicate_lines": 1 - len(set(lines)) / len(lines),
            "short_words": sum(len(w) <= 3 for w in words) / n, "longest_word": np.log1p(max(map(len, words), default=0)), "entropy": -sum(p * np.log2(p) for p in (raw.count(bytes([c])) / size for c in set(raw))),
        }
        for name, value in want.items():
            assert abs(got[quality.FEATURES.index(name)] - value) < 1e-9, (name, text[:40])


def test_scores_against_plain_sums(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    model = quality.learn(x, ((x[:, 0] + x[:, 1] * x[:, 2]) > 0.8).astype(float))
    for row, got in zip(x[:50], quality.scores_of(x[:50], model), strict=True):
        raw = model.intercept + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        raw += sum(t[sum(row[i] >= e for e in a), sum(row[j] >= e for e in b)] for i, j, a, b, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9
    monkeypatch.setattr(quality, "SLICE_BYTES", 7)
    monkeypatch.setattr(quality, "SLICE_ROWS", 2)
    texts = pa.array(["a b", None, "", "longer than a slice is", "x"] * 3)
    cut = quality.featurise(texts)
    monkeypatch.undo()
    assert (cut == quality.featurise(texts)).all()


def test_toxicity_ratios_and_scores_against_plain_python(spark):
    docs, labels, _ = labelled(spark, 90)
    model = toxicity.fit(docs, labels, shrink=0.0)
    grams = lambda t: {g for w in t.lower().encode().split() for p in [b" " + w + b" "] for n in toxicity.GRAMS for g in (p[k : k + n] for k in range(len(p) - n + 1))}
    bucket = lambda g: int(toxicity.common.mix64(np.array([int.from_bytes(g, "little") + (len(g) << 40)], np.uint64))[0] >> np.uint64(64 - toxicity.BUCKET_BITS))
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    texts = ["the vermin on", "wretch", "", "ab re tion zzz"]
    for text, got in zip(texts, toxicity.scores(pa.array(texts), model), strict=True):
        raw = model.intercept + sum(weight.get(b, 0.0) for b in {bucket(g) for g in grams(text)})
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9
    # With shrink = 0 every feature of the training texts is there whose ratio is not zero, and none else.
    learned = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and 1 < r.doc_id < 90 and remainder(r.doc_id, 4) != 2}
    seen = {bucket(g) for t in learned.values() for g in grams(t)}
    assert set(model.index.tolist()) <= seen | {bucket(g) for r in docs.collect() if r.doc_id in (0, 1, 9_999) for g in grams(r.text or "")}
    assert len(model.index) > 0.9 * len(seen)
    assert 0 < len(toxicity.fit(docs, labels).index) < len(model.index)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_do_not_depend_on_the_order_of_rows(spark, module):
    docs, labels, _ = labelled(spark, 150)
    more = docs.unionByName(docs.filter("doc_id < 40").selectExpr("doc_id", "concat(text, ' again') as text", "lang", "source"))
    rows = more.collect()
    texts = pa.array(["the vermin on", "ab***", ""])
    got = [module.scores(texts, module.fit(spark.createDataFrame(x, more.schema).repartition(n), labels)) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert (got[0] == got[1]).all()
