"""Media columns: content-addressed payloads in tar shards, with rows that carry digest, offset and length.

A text's payload is its UTF-8 bytes, followed by spaces up to a positive multiple of ROW bytes. It is stored as a PNG image
of 8-bit RGB samples, WIDTH pixels to a row, without loss. A task writes the images of its rows into one tar shard in
the shared folder, each distinct payload once, under the name <sha256 of the payload>.png; its rows carry the digest, the shard,
and the image's place in it. A second pass goes through the shards: a read of a member's first HEADER bytes alone fills
the metadata columns, and a read of the whole member the checksums and the feature.

Shards get names that no other attempt of a task shares, and rows name only shards of attempts that ended well, so lost
and repeated tasks do no harm; sweep() deletes the shards of attempts that failed. Null text is an empty payload (ROW spaces). Equal
texts have equal values in all columns but doc_id, shard and offset. Rows that share a doc_id, or have none, are rows of their own. Only the id
and the text are read, so other columns may have any name; an empty table gives no rows and no shards. A worker holds a few copies of a
batch or of one longer text. Shards are read and written through the file system that the shared folder's URI names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
#: The signature and the IHDR chunk.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1

ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, digest string, shard string, offset long, width int, height int, bit_depth int"


def payload(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(data: bytes) -> bytes:
    lines = np.zeros((len(data) // ROW, ROW + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    at, packed = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """16 hex digits: of an 8 by 8 grid over the samples, which cells are brighter than the next (the last: than the first)."""
    samples = np.frombuffer(data, np.uint8).astype(np.int64)
    at = np.arange(65) * len(samples) // 64
    sums = np.concatenate([[0], np.cumsum(samples)])
    mean = (sums[at[1:]] - sums[at[:-1]]) / np.diff(at)
    return np.packbits(mean > np.roll(mean, -1)).tobytes().hex()


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes shards into folder as its rows are computed; ROWS. Settle it before the shards are read."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(folder)
        name, shard, at, held = f"{uuid.uuid4().hex}.tar", None, 0, {}
        for batch in common.batches(parts):
            rows = []
            for doc, text in zip(common.column(batch, "doc_id").to_pylist(), common.column(batch, "text").cast(pa.binary()).to_pylist(), strict=True):
                data = payload(text)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in held:
                    if shard is None:
                        files.create_dir(path, recursive=True)
                        shard = files.open_output_stream(f"{path}/{name}")
                    image = to_png(data)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    shard.write(head + image + bytes(-len(image) % 512))
                    held[digest] = (at + len(head), len(image))
                    at += len(head) + len(image) + -len(image) % 512
                rows.append((doc, len(text), digest, name, *held[digest]))
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.write(bytes(1024))
            shard.close()

    return common.texts(docs).mapInArrow(write, ROWS)


def read(rows: DataFrame, folder: str) -> DataFrame:
    """COLUMNS: rows of store() with what their images say, each distinct image of a shard read once by a task."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(folder)
        shard, file, known = None, None, {}
        for batch in parts:
            out = []
            for doc, n, digest, name, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    if file is not None:
                        file.close()
                    shard, file, known = name, files.open_input_file(f"{path}/{name}"), {}
                if at not in known:
                    file.seek(at)
                    size = png_header(file.read(HEADER))
                    file.seek(at)
                    image = file.read(length)
                    data = from_png(image)
                    if hashlib.sha256(data).hexdigest() != digest:
                        raise ValueError(f"{digest} of {name} holds other content")
                    known[at] = (len(data), digest, zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)), size
                found, size = known[at]
                out.append((doc, n, *found, digest, name, at, *size))
            cols = list(zip(*out, strict=True))
            i, s, w = pa.int64(), pa.string(), pa.int32()
            names = [x.split()[0] for x in COLUMNS.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (i, i, i, s, i, i, s, s, s, s, i, w, w, w), strict=True)], names)

    # Rows of a shard are as many as one task's were, so shards make even groups.
    return rows.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(each, COLUMNS)


def sweep(rows: DataFrame, folder: str) -> int:
    """Deletes the shards in folder that no row of rows (shard) names, once rows are settled: those of attempts that failed. How many."""
    files, path = _opened(folder)
    from pyarrow import fs

    named = {r["shard"] for r in rows.select("shard").distinct().collect()}  # one a task
    found = [x.path for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".tar") and x.base_name not in named]
    for x in found:
        files.delete_file(x)
    return len(found)


def media(docs: DataFrame) -> DataFrame:
    """Stores docs in the shared folder and returns COLUMNS from what is read back."""
    folder = common.scratch(docs.sparkSession, "media")
    rows = common.settled(store(docs, f"{folder}/shards"), f"{folder}/rows", compression="zstd")
    sweep(rows, f"{folder}/shards")
    return read(rows, f"{folder}/shards")
