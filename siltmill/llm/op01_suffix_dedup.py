"""Repeated substrings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. A window (a string of `length` bytes)
belongs to the smallest hash of its short substrings, its anchor; equal windows have equal anchors at equal places. Texts
are cut into segments, runs of windows with one anchor's place, and only anchors of two places or more go on.

Segments are strings over columns counted from their anchor. Each shard of the texts has a transform of its segments:
column by column from the right, the byte of each segment in the order of what follows it. Transforms are merged by
interleave refinement: the merge starts with the shards laid end to end and, for each column, reads every shard's
transform in the order of the current interleave and distributes the interleave by those bytes. With the interleave goes
the column up to which neighbours agree, so the common prefixes of all windows come out of one sweep, suffixes are
never sorted together, and a window is repeated where a neighbour agrees with it on `length` bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, discard, small, stored

GRAM = 32  # bytes of an anchor
SHARDS = 64  # a merge reads the transforms of so many shards
BLOCK = 1 << 20  # windows of a text that are cut at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1:] * base)])
    _POWERS[int(base)] = have
    return have[:n]


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each substring of `width` bytes."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * _powers(_ODD, len(buf)), out=total[1:])
    h = (total[width:] - total[:-width]) * _powers(_ODD_INVERSE, n)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def segments(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, one past the last window, anchor's place) of each run of windows that share an anchor's
    place. Texts of more than BLOCK windows are cut block by block."""
    if len(raw) - length + 1 > BLOCK:
        blocks = [(at, segments(raw[at : at + BLOCK + length - 1], length)) for at in range(0, len(raw) - length + 1, BLOCK)]
        return np.concatenate([b[0] for _, b in blocks]), *(np.concatenate([at + b[i] for at, b in blocks]) for i in (1, 2, 3))
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    h = rolling(np.frombuffer(raw, np.uint8), GRAM)
    wide = length - GRAM + 1
    rank = np.full(-(-len(h) // wide) * wide, np.uint64(2**64 - 1))
    rank[: len(h)] = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    grid = rank.reshape(-1, wide)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:n], left[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], turn]), np.concatenate([turn, [n]])
    return h[at[first]].view(np.int64), first, last, at[first]


class ShardTransforms:
    """The transforms of a merge's shards, laid end to end: rows are grouped by shard and, in a shard, ordered by their
    bytes right of the current column. Symbols are bytes and 1; 0 is no byte."""

    def __init__(self, symbols: np.ndarray, shard: np.ndarray):
        self.symbols, self.order = symbols, np.argsort(shard, kind="stable")
        self.key = shard[self.order].astype(np.uint16) << 9

    def read(self, column: int) -> np.ndarray:
        """The transforms' symbols at a column; the rows are then in the order that starts with it."""
        out = self.symbols[column][self.order]
        self.order = self.order[np.argsort(self.key | out, kind="stable")]
        return out


def range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a + 1] to values[b] for each a < b."""
    level = np.log2(b - a).astype(np.int64)
    table = [values]
    for k in range(int(level.max(initial=0))):
        up = table[-1].copy()
        np.minimum(up[: len(up) - (1 << k)], table[-1][1 << k :], out=up[: len(up) - (1 << k)])
        table.append(up)
    grid = np.stack(table)
    return np.minimum(grid[level, a + 1], grid[level, b + 1 - (1 << level)])


def merge_transforms(shards: ShardTransforms, columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column from the last to the first: (column, rows in the shards' order, for each the most symbols from that
    column on that it has in common with a neighbour in the merged order)."""
    interleave = (shards.key >> 9).astype(np.uint8)
    until = np.full(len(interleave) + 1, columns, np.int16)  # the column up to which a position agrees with the one before
    where = np.argsort(interleave, kind="stable")
    for column in range(columns - 1, -1, -1):
        symbol = np.empty(len(interleave), np.uint16)
        symbol[where] = shards.read(column)
        to = np.argsort(symbol, kind="stable")
        symbol, interleave = symbol[to], interleave[to]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)) + 1
        now = np.full(len(until), column, np.int16)
        if len(same):
            now[same] = range_least(until, to[same - 1], to[same])
        until = now
        where = np.argsort(interleave, kind="stable")
        yield column, shards.order, (np.maximum(until[:-1], until[1:]) - column)[where]


def repeated_windows(parts: list[bytes], places: list[int], shard: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each part, the runs of windows' starts whose `length` bytes also are in another part at the same distance from
    its anchor (places: the anchor in each part)."""
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(parts) < 2:
        return out
    left, sizes = np.array(places), np.array([len(p) for p in parts])
    zero = int(left.max())
    columns = zero + int((sizes - left).max())
    symbols = np.zeros((len(parts), columns), np.uint16)
    for i, (p, a) in enumerate(zip(parts, (zero - left).tolist())):
        symbols[i, a : a + len(p)] = np.frombuffer(p, np.uint8)
        symbols[i, a : a + len(p)] += 1
    grid = np.ascontiguousarray(symbols.T)
    hit = np.zeros((min(zero + 1, columns - length + 1) + 2, len(parts)), bool)  # an empty line before and after
    for column, rows, common in merge_transforms(ShardTransforms(grid, np.array(shard, np.uint8)), columns):
        if column < len(hit) - 2:
            hit[column + 1, rows] = common >= length
    turns = hit[1:] != hit[:-1]
    who, line = np.nonzero(turns.T)
    for i, a, b in zip(who[::2].tolist(), line[::2].tolist(), line[1::2].tolist()):
        out[i].append((a - zero + places[i], b - zero + places[i]))
    return out


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows starting in the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [(a, b) for a, b in out]


def table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def in_batches(rows: Iterator[tuple[int, tuple]], fields: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """rows: (bytes that it holds, row)."""
    batch: list[tuple] = []
    held = 0
    for size, row in rows:
        batch.append(row)
        held += size + 100
        if held > 4_000_000:
            yield table(batch, list(fields), list(fields.values()))
            batch, held = [], 0
    if batch:
        yield table(batch, list(fields), list(fields.values()))


#: key: what windows of the segment have in common; q: the anchor's place in it; n: places (2: two or more).
SEGMENT = "name binary, key long, q int, piece binary, n int, shard int"
_FIELDS = {"name": pa.binary(), "key": pa.int64(), "q": pa.int32(), "piece": pa.binary(), "n": pa.int32(), "shard": pa.int32()}


def collapsed(segments: DataFrame) -> DataFrame:
    """Equal segments as one row with their first and last shard; done before the shuffle, too."""
    least = [F.first(c).alias(c) for c in ("key", "q", "piece")]
    return segments.groupBy("name").agg(*least, F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min("shard").alias("s0"), F.max("shard").alias("s1"))


def runs_of(windows: int, q: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(number, farthest, nearest distance from the anchor) of the runs of at most `width` windows of a segment."""
    for r in range(max(0, q - windows + 1) // width, q // width + 1):
        yield r, min(q, (r + 1) * width - 1), max(r * width, q - windows + 1)


def marks(width: int, length: int):
    """name, run, narrow (key of the run), n: all windows of a run share length - width + 1 bytes, which make its key."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, key, q, piece, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    for r, _, _ in runs_of(len(piece) - length + 1, q, width):
                        common = piece[q - r * width : q - (r + 1) * width + 1 + length]
                        narrow = hashlib.blake2b(common, digest_size=8, key=f"{key} {r} {width}".encode()).digest()
                        yield 0, (name, r, int.from_bytes(narrow, "little", signed=True), n)

        yield from in_batches(rows(), {"name": pa.binary(), "run": pa.int32(), "narrow": pa.int64(), "n": pa.int32()})

    return emit


def narrower(width: int, length: int):
    """The wanted runs of segments as segments of their own, with their parent and their place in it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, q, piece, n, wanted in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    keys = {w["run"]: w["narrow"] for w in wanted}
                    for r, far, near in runs_of(len(piece) - length + 1, q, width):
                        if r in keys:
                            part = piece[q - far : q - near + length]
                            own = hashlib.md5(b"%d %d " % (far, keys[r]) + part).digest()
                            yield len(part), (own, keys[r], far, part, n, name[0] % SHARDS, name, q - far)

        yield from in_batches(rows(), _FIELDS | {"parent": pa.binary(), "shift": pa.int32()})

    return emit


def repeated_in_segments(rows: DataFrame, length: int, bucket_rows: int, width: int) -> DataFrame:
    """name, a, b (a written table): runs of repeated windows of collapsed segments, of which each key has two or more.

    Keys fall into buckets of about bucket_rows segments. A key of more than twice that is split: its segments fall into
    narrower runs of windows, keyed by more of the bytes that they share; runs whose key occurs once are dropped before
    any bytes move, the others are solved in the same way. Runs of one window are equal where their keys are, so the
    splitting ends with tasks of bounded size.
    """
    counts = stored(rows.groupBy("key").agg(F.sum("n").alias("rows")), "segment-counts")
    total, most = counts.agg(F.sum("rows"), F.max("rows")).first()
    buckets = max(1, math.ceil((total or 0) / bucket_rows))
    split = (most or 0) > 2 * bucket_rows and width > 1
    large = counts.where(F.col("rows") > 2 * bucket_rows).select("key")  # less than one for each bucket
    small = rows.join(large, "key", "left_anti") if split else rows
    entries = small.select("name", "key", "q", "piece", F.explode(F.when(F.col("n") > 1, F.array("s0", "s1")).otherwise(F.array("s0"))).alias("shard"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(pdf["piece"].tolist(), pdf["q"].tolist(), pdf["shard"].tolist(), length)
        spans = {(name, a, b) for name, own in zip(pdf["name"], found) for a, b in own}
        return pd.DataFrame(list(spans), columns=["name", "a", "b"])

    hits = entries.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(solve, "name binary, a int, b int")
    if not split:
        done = stored(hits, "repeated-windows")
        discard(counts)
        return done
    heavy = rows.join(large, "key", "left_semi").select("name", "key", "q", "piece", "n")
    less = max(1, width // 8)
    marked = stored(heavy.mapInArrow(marks(less, length), "name binary, run int, narrow long, n int"), "narrower-keys")
    shared = stored(marked.groupBy("narrow").agg(F.sum("n").alias("n")).where("n > 1").select("narrow"), "shared-narrower-keys")
    wanted = marked.join(shared, "narrow").groupBy("name").agg(F.collect_list(F.struct("run", "narrow")).alias("wanted"))
    cut = heavy.join(wanted, "name").select("name", "q", "piece", "n", "wanted").mapInArrow(narrower(less, length), f"{SEGMENT}, parent binary, shift int")
    cut = stored(cut, "narrower-segments")
    parts = stored(collapsed(cut), "different-narrower-segments")
    inside = repeated_in_segments(parts, length, bucket_rows, less)
    parents = cut.select("name", "parent", "shift").join(inside, "name").select(F.col("parent").alias("name"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
    done = stored(hits.unionByName(parents), "repeated-windows")
    discard(counts, marked, shared, cut, parts, inside)
    return done


def repeated_spans(docs: DataFrame, length: int = 400, bucket_rows: int = 16_384) -> DataFrame:
    """digest, n_bytes, spans (array of start, end: maximal removed runs), kept (the other bytes) of each different text
    that has any.

    One task solves about bucket_rows segments, three times that at most, of at most 2 * length bytes. Equal segments are one row before they are
    shuffled, however many rows share them; it enters the merge from the first and the last shard that hold it. Only
    texts that share an anchor with another place are stored and cut.
    """
    long = docs.where(F.octet_length("text") >= length).select(digest().alias("digest"), F.encode("text", "UTF-8").alias("raw"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            held = 0
            for key, raw in zip(b.column(0), b.column(1), strict=True):
                parts.append((key.as_py(), *segments(raw.as_py(), length)))
                held += len(parts[-1][1])
                if held > 100_000:
                    yield anchor_rows(parts)
                    parts, held = [], 0
            if parts:
                yield anchor_rows(parts)

    def anchor_rows(parts):
        sizes = [len(x[1]) for x in parts]
        keys = pa.array([x[0] for x in parts], pa.binary()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
        columns = [pa.array(np.concatenate([x[i] for x in parts]).astype(t)) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32))]
        return pa.RecordBatch.from_arrays([keys, *columns], ["digest", "anchor", "first", "last", "at"])

    found = stored(long.mapInArrow(anchors, "digest binary, anchor long, first int, last int, at int"), "anchors")
    shared = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    marked = stored(found.join(shared, "anchor").groupBy("digest").agg(F.collect_set(F.struct("first", "last", "at", "anchor")).alias("cuts")), "shared-cuts")
    some = long.join(small(marked.select("digest"), marked.count()), "digest", "left_semi")
    texts = some.groupBy("digest").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"))
    cut = stored(texts.join(marked, "digest"), "texts-with-shared-anchors")
    discard(found, shared, marked)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, raw, copies, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    raw = raw.as_py()
                    for c in cuts:
                        piece = raw[c["first"] : c["last"] - 1 + length]
                        yield len(piece), (hashlib.md5(piece).digest(), c["anchor"], c["at"] - c["first"], piece, min(copies, 2), key[0] % SHARDS)

        yield from in_batches(rows(), _FIELDS)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, raw, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    raw = raw.as_py()
                    for c in cuts:
                        yield 0, (hashlib.md5(raw[c["first"] : c["last"] - 1 + length]).digest(), key, c["first"])

        yield from in_batches(rows(), {"name": pa.binary(), "digest": pa.binary(), "first": pa.int32()})

    parts = stored(collapsed(cut.select("digest", "raw", "copies", "cuts").mapInArrow(pieces, SEGMENT)), "segments")
    hits = repeated_in_segments(parts, length, bucket_rows, length - GRAM + 1)
    discard(parts)
    where = cut.select("digest", "raw", "cuts").mapInArrow(names, "name binary, digest binary, first int")
    spans = where.join(hits, "name").groupBy("digest").agg(F.collect_list(F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))).alias("starts"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, raw, starts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    raw = raw.as_py()
                    gone = covered([(s["a"], s["b"]) for s in starts], length)
                    edges = [0, *(x for g in gone for x in g), len(raw)]
                    kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    yield len(kept), (key, len(raw), [{"start": a, "end": z} for a, z in gone], kept)

        yield from in_batches(rows(), {"digest": pa.binary(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept": pa.binary()})

    return cut.select("digest", "raw").join(spans, "digest").mapInArrow(take, "digest binary, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Null texts are empty. A text in two or more rows goes whole if it has at least `length` bytes, else it stays.
    Repeated rows and null ids stay rows; other columns are ignored; an empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", digest().alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("whole"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    known = stored(repeated_spans(docs, length).select("digest", removed.alias("removed"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("kept")), "results-by-text")
    return rows.join(known, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
