"""Best-fit packing with exact complements.

Pieces are packed by their lengths alone: one table row for each length says how many pieces have it. For each length, from
the longest, what is missing to a full sequence is looked up among the lengths there are, their pair sums and their triple
sums, and combinations that fill the gap exactly are used up as often as counts allow. A gap without such a combination
takes the longest piece that fits, and what that leaves is looked up again. The plan has at most a few thousand kinds of
sequence, whatever the number of documents; pieces are numbered within their length, and a number's range in the plan says
its sequence and place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, stored, text_or_empty
from .tokens import coder, default_tokenizer

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, part int, place long"


class Complements:
    """Which lengths, pairs and triples of lengths add up to a sum, under the counts that are left."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.refresh()

    def refresh(self) -> None:
        """Sums of one, two and three lengths that still have pieces."""
        one = (self.counts > 0).astype(np.float32)
        size = 1 << (3 * len(one)).bit_length()
        f = np.fft.rfft(one, size)
        self.one = one > 0
        self.two = np.fft.irfft(f * f, size)[: len(one)] > 0.5
        self.three = np.fft.irfft(f * f * f, size)[: len(one)] > 0.5

    def _longest(self, total: int, rest: np.ndarray) -> Iterator[int]:
        """Lengths a, longest first, for which rest says that total - a can be had."""
        a = np.flatnonzero(self.one[:total] & rest[total:0:-1])
        return reversed(a.tolist())

    def times(self, kind: tuple[int, ...]) -> int:
        return min(int(self.counts[a]) // n for a, n in Counter(kind).items())

    def filling(self, used: tuple[int, ...], gap: int, most: int = 3) -> tuple[int, ...] | None:
        """used and up to `most` lengths (three at most) that add up to gap, such that the counts allow them together."""
        if self.one[gap] and self.times((*used, gap)):
            return (*used, gap)
        if most > 1 and self.two[gap]:
            for a in self._longest(gap, self.one):
                if a >= gap - a and self.times((*used, a, gap - a)):
                    return (*used, a, gap - a)
        if most > 2 and self.three[gap]:
            for a in self._longest(gap, self.two):
                if 3 * a < gap:
                    break
                for b in self._longest(gap - a, self.one):
                    if a >= b >= gap - a - b and self.times((*used, a, b, gap - a - b)):
                        return (*used, a, b, gap - a - b)
        return None

    def take(self, kind: tuple[int, ...], times: int) -> None:
        for a, n in Counter(kind).items():
            self.counts[a] -= n * times
        if any(self.counts[a] == 0 for a in kind):
            self.refresh()


def sequences(kinds: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(n for _, n in kinds)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences): counts[length] pieces, 0 to the sequences' size, all placed.

    Combinations that fill exactly can use up short pieces that longer ones would need, so the plan is made with
    complements of up to three, two and one pieces, and the one with the fewest sequences is taken.
    """
    return min((_plan(counts, most) for most in (3, 2, 1)), key=sequences)


def _plan(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first: a gap that up to `most` pieces fill exactly is closed; else the longest piece that fits goes in,
    and what it leaves is a gap in turn. All sequences that counts allow are made at once."""
    left = Complements(np.array(counts, np.int64))
    size = len(counts) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    for length in range(size, 0, -1):
        while left.counts[length]:
            kind, gap = (length,), size - length
            while gap:
                if whole := left.filling(kind, gap, most):
                    kind = whole
                    break
                fits = next((a for a in reversed(np.flatnonzero(left.one[: gap + 1]).tolist()) if left.times((*kind, a))), None)
                if fits is None:
                    break
                kind, gap = (*kind, fits), gap - fits
            n = left.times(kind)
            left.take(kind, n)
            out.append((kind, n))
    return out


def placements(kinds: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, past, sequence, offset): the pieces of a length numbered first to past-1 stand at that offset of
    sequences counted from `sequence`."""
    taken: Counter = Counter()
    out = []
    sequence = 0
    for kind, n in kinds:
        offset = 0
        for length in kind:
            out.append((length, taken[length], taken[length] + n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return out


def cut_pieces(docs: DataFrame, size: int, end_id: int, tokenizer: str) -> DataFrame:
    """Pieces with their ids, the task that made them (part) and their number among its pieces of that length (place)."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = coder(tokenizer), TaskContext.get().partitionId()
        names = ["doc_id", "piece", "start", "length", "ids", "part", "place"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        seen: Counter = Counter()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = c.encode(text.as_py()) + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % size or size
                    rows.append((doc, piece, at, length, ids[4 * at : 4 * (at + length)], part, seen[length]))
                    seen[length] += 1
                    at, piece = at + length, piece + 1
                held += len(ids)
                if held > 8_000_000 or len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut, SCHEMA)


def pack_best_fit(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start, length, ids (little-endian uint32), sequence_id (gapless from
    0), offset.

    A document is its text's ids and the end id; one of more than `size` ids is cut into pieces of `size`, of which the
    first may be shorter. A null or empty text is one piece with the end id. Null ids and repeated rows stay, each on its
    own; other columns are ignored, whatever their names; an empty table gives no rows.

    Ids are made once and written to the shared folder. The driver sees one number for each length, at most `size`, and
    plans with those. A length that many pieces share is numbered by the tasks that made them, so it is never in one task.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, size, end_id, tokenizer or default_tokenizer()), "bestfit-pieces")
    tallies = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "bestfit-tallies")
    counts = np.zeros(size + 1, np.int64)
    for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = tallies.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if tallies.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    ranges = spark.createDataFrame(placements(plan(counts)) or [(0, 0, 0, 0, 0)], "_length long, first long, past long, sequence long, offset long")
    numbered = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    inside = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    placed = numbered.join(F.broadcast(ranges), inside)  # bounded by the lengths, not by the documents
    return placed.select("doc_id", "piece", "start", "length", "ids", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
