import hashlib
import io
import tarfile
import zlib

from loomgraph.llm import common, media

from .data import no_docs, odd_docs, odd_rows


def test_round_trip(spark):
    got = media.media(odd_docs(spark)).collect()
    want = []
    for doc, text, *_ in odd_rows():
        raw = (text or "").encode()
        data = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want.append((str(doc), len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), media.feature(data), len(data) // 192))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature, r.height) for r in got) == sorted(want)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        assert r.width == 64 and r.bit_depth == 8


def test_shards_are_tar_files_with_one_member_a_payload(spark, tmp_path):
    rows = media.store(odd_docs(spark).coalesce(1), f"file://{tmp_path}/shards").collect()
    (shard,) = {r.shard for r in rows}
    with tarfile.open(tmp_path / "shards" / shard) as tar:
        members = {m.name: (m.offset_data, m.size) for m in tar}
        for r in rows:
            assert members[f"{r.digest}.png"] == (r.offset, r.length)
            image = tar.extractfile(f"{r.digest}.png").read()
            assert hashlib.sha256(media.from_png(image)).hexdigest() == r.digest
            assert media.png_header(io.BytesIO(image).read(media.HEADER))[0] == 64
    assert len(members) == len({r.digest for r in rows})


def test_no_documents(spark):
    assert media.media(no_docs(spark)).count() == 0


def test_batches_keep_all_rows_in_order():
    import pyarrow as pa

    part = pa.record_batch([pa.array(["a" * k for k in range(50)])], ["text"])
    cut = list(common.batches(iter([part]), limit=100))
    assert [len(t) for b in cut for t in b.column(0).to_pylist()] == list(range(50)) and len(cut) > 5


def test_shards_of_failed_attempts_are_swept(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = media.common.settled(media.store(odd_docs(spark), folder), f"file://{tmp_path}/rows")
    (tmp_path / "shards" / "lost.tar").write_bytes(b"half")
    before = media.read(rows, folder).count()
    assert media.sweep(rows, folder) == 1 and not (tmp_path / "shards" / "lost.tar").exists()
    assert media.sweep(rows, folder) == 0 and media.read(rows, folder).count() == before
