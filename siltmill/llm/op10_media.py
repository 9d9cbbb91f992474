"""Media columns: content-addressed payloads in tar shards.

A payload is stored as the pixels of an 8-bit RGB PNG, 64 pixels (192 bytes) wide, under the digest of its content.
Each task appends its different payloads to tar shards of its own in the shared folder, so nothing is shuffled; the rows
carry shard, digest, offset and length. Metadata columns come from reads of the header's range only; the payload's own
columns from reads of its whole range.
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
from pyspark.sql import functions as F

from .common import qualified, filesystem, shared_dir

WIDTH = 64
ROW = 3 * WIDTH
HEADER = 33  # PNG signature and IHDR chunk
_SIGN = b"\x89PNG\r\n\x1a\n"
MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(raw: bytes) -> bytes:
    """raw and bytes 32 up to a positive multiple of a pixel row."""
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    height = len(payload) // ROW
    lines = np.zeros((height, ROW + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    """Width, height, bit depth and channels from the first HEADER bytes."""
    if head[:8] != _SIGN or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[colour]}


def png_samples(png: bytes) -> bytes:
    """The samples of a PNG that to_png wrote; a wrong checksum raises."""
    meta, at, data = png_header(png), 8, b""
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("checksum of a PNG chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(meta["height"], ROW + 1)
    return lines[:, 1:].tobytes()


class _Shards:
    """Tar shards of one task."""

    def __init__(self, folder: str, most: int):
        self.fs, self.root = filesystem(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.most, self.out, self.at, self.name, self.held = most, None, 0, "", {}

    def put(self, name: str, body) -> tuple[str, int, int]:
        if self.out is None or self.at > self.most:
            self.close()
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at, self.held = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, {}
        if name not in self.held:
            data = body()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            head = info.tobuf(tarfile.PAX_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.held[name] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.held[name]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None

    def __enter__(self) -> _Shards:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def store_texts(docs: DataFrame, folder: str | None = None, shard_bytes: int = 128 << 20) -> tuple[DataFrame, str]:
    """(manifest: doc_id, n_bytes, digest, shard, offset, length; folder of the shards).

    Null texts are empty. A content is stored once in each shard that has a row with it. Shards get new names on each
    attempt of a task and the manifest is a written table, so a lost executor leaves at most an unused shard.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else shared_dir(spark, "media")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Shards(f"{folder}/shards", shard_bytes) as shards:
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = (text.as_py() or "").encode("utf-8", "replace")
                    payload = padded(raw)
                    name = hashlib.sha256(payload).hexdigest()
                    rows.append((doc, len(raw), name, *shards.put(f"{name}.png", lambda p=payload: to_png(p))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), folder


def _ranges(batches, folder: str, size):
    """(batch, iterator of the stored bytes of its rows); size: None for all."""
    fs, root = filesystem(folder)
    open_shard, name = None, None

    def read(b):
        nonlocal open_shard, name
        for shard, offset, length in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True):
            if shard != name:
                if open_shard is not None:
                    open_shard.close()
                open_shard, name = fs.open_input_file(f"{root}/shards/{shard}"), shard
            yield open_shard.read_at(min(length, size or length), offset)

    for b in batches:
        yield b, read(b)


def with_metadata(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest with width, height, bit_depth, channels; reads only the header's range of each payload."""
    names = ["width", "height", "bit_depth", "channels"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _ranges(batches, folder, HEADER):
            meta = [png_header(x) for x in data]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[n] for m in meta], pa.int32()) for n in names)], [*b.schema.names, *names])

    return manifest.mapInArrow(fill, f"{MANIFEST}, {', '.join(f'{n} int' for n in names)}")


def feature(samples: bytes) -> str:
    """Mean and spread of the samples, and the mean step between neighbours, in fixed point."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32)
    step = np.abs(np.diff(x)).sum() / max(1, len(x) - 1)
    return f"mean={x.mean():.4f};std={x.std():.4f};step={step:.4f}"


def read_media(described: DataFrame, folder: str) -> DataFrame:
    """described (with_metadata) and, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""
    more = [("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _ranges(batches, folder, None):
            rows = []
            for png in data:
                p = png_samples(png)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(png).hexdigest(), feature(p)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(more))], [*b.schema.names, *(n for n, _, _ in more)])

    extra = ", ".join(f"{n} {t}" for n, t, _ in more)
    return described.mapInArrow(fill, f"{MANIFEST}, width int, height int, bit_depth int, channels int, {extra}")


def dealt_by_bytes(manifest: DataFrame, task_bytes: int = 16 << 20) -> DataFrame:
    """The manifest's rows in partitions that read about task_bytes of neighbouring payloads each, in their order."""
    total = manifest.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / task_bytes)
    return manifest.repartition(max(1, -(-total // task_bytes)), "shard", stretch).sortWithinPartitions("shard", "offset")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """All columns above for each row of docs; repeated rows stay, null ids stay, other columns are ignored, an empty
    table gives no rows."""
    manifest, where = store_texts(docs, folder)
    manifest = dealt_by_bytes(manifest)
    return read_media(with_metadata(manifest, where), where)
