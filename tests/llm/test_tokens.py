import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import packing, token_files
from loomgraph.llm.tokenize import default_vocabulary, encoder

from .data import no_docs, odd_docs, odd_rows


def ids_of(text):
    return [*encoder(default_vocabulary()).library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    parts = ["the", " ", "  ", "\n", "\t", "a", ".", "'s", "é", "9", " ", "　", "!", "\n\n", "<|endoftext|>", "日本", "\x00", "\x1c", "x" * 60, "'ll", "ß,", "½", " ", "\u0085", "Ω", " \n"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, counts = encoder(default_vocabulary()).encode(pa.array(texts), 0)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == ids_of(text), text


def test_token_ids(spark):
    got = token_files.token_ids(odd_docs(spark)).collect()
    want = sorted((("" if d is None else f"{d:09d}", len(i), crc(i)) for d, t, *_ in odd_rows() for i in [ids_of(t)]))
    assert sorted(("" if r.doc_id is None else f"{r.doc_id:09d}", r.n_tokens, r.ids_crc32) for r in got) == want
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and rows[0].doc_id is None


def test_selective_reads(spark, tmp_path):
    token_files.write_ids(odd_docs(spark), f"file://{tmp_path}/ids")
    meta = token_files.read_ids(spark, f"file://{tmp_path}/ids", 3, 5, ids=False)
    assert sorted(r.doc_id for r in meta.collect()) == [3, 4, 5]
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,3)" in plan


def test_no_documents(spark):
    assert token_files.token_ids(no_docs(spark)).count() == 0
    assert packing.pack(no_docs(spark)).count() == 0


@pytest.mark.parametrize("sequence", [2048, 64])
def test_packing(spark, sequence):
    got = packing.pack(odd_docs(spark), sequence=sequence).toPandas()
    want = sorted(crc(i[a:b]) for _, t, *_ in odd_rows() for i in [ids_of(t)] for a, b in cuts(len(i), sequence))
    assert sorted(got.ids_crc32) == want
    for _, group in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert group.offset.tolist() == (group.length.cumsum() - group.length).tolist() and group.length.sum() <= sequence
    total = sum(len(ids_of(t)) for _, t, *_ in odd_rows())
    assert got.sequence_id.nunique() <= -(-total // sequence) * 1.1 + 1


def cuts(n, sequence):
    first = n % sequence or sequence
    return [(0, first), *((a, a + sequence) for a in range(first, n, sequence))]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 40))), reverse=True)
        room = []
        for n in lengths:  # one by one: the fullest sequence that has room
            fits = [(r, k) for k, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(20 - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        for length, _, n, each, first, offset in packing.plan(counts, 20).tolist():
            for k in range(n):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert len(used) == len(room)
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 20


def test_added_tokens_are_those_of_the_library_as_it_is():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    mark = "<|endoftext|>"
    texts = [f"a{mark}b", mark, mark * 3, f" {mark} ", f"x y{mark}\n z.{mark}", "<|endof", "text|> after", "", f"é{mark}日本 {mark}!", mark[:-1], "<" + mark + ">", "plain words"]
    rng = random.Random(9)
    texts += ["".join(rng.choice([mark, mark[:6], mark[6:], " ", "\n", "a", "the", ".", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    ids, counts = encoder(default_vocabulary()).encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text
