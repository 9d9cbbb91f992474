"""Packing by power-of-two decomposition.

Each document's ids (and one end id) are cut by the binary digits of their number: first the pieces of the largest
length, then one for each lower set bit. A sequence holds one piece, so no sequence crosses documents, none is padded,
and equal lengths share a bucket (log2 of the length) that a loader can batch without padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import coder, default_tokenizer

SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, bucket int"


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two up to `most` (itself one) that add up to n, longest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack_pow2(docs: DataFrame, max_len: int = 2048, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian uint32; null without with_ids), ids_crc32,
    doc_tokens, bucket, sequence_id, offset (0: a sequence is one piece).

    A null or empty text is one piece with the end id. A null doc_id stays null. Repeated rows are packed each on its
    own. Other columns are ignored, whatever their names. An empty table gives no rows. sequence_id numbers the pieces
    within the partitions of the input's scan, so it needs no shuffle; it is unique, not gapless.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "bucket"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = c.encode(text.as_py()) + end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, max_len):
                    piece = ids[4 * at : 4 * (at + length)]
                    rows.append((doc, at, length, piece if with_ids else None, zlib.crc32(piece), n, length.bit_length() - 1))
                    at += length
                held += len(ids)
                if held > 8_000_000 or len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    pieces = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(pack, SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
