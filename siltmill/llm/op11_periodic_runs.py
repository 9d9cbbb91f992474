"""Periodic runs of words, found by harmonic grid probing.

A run of period p that spans at least two periods agrees with itself, p words on, over a stretch of p places or more, and
so at one of the grid points 0, p, 2p, ... at least. For each period only those points are probed: word equality at jp and
(j+1)p, n/1 + n/2 + n/3 + ... probes in all, taken as strided array comparisons. The few that survive are extended to both
sides by comparing chunks that double in length. Grid points within what the same period has given, or a period that
divides it, are skipped. A document is one row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_EDGE = 3  # words that a probe looks at on each side
_SHORT = 2048  # texts of up to so many words have all their probes listed


def _listed(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, second place) of every probe of a text of n words, ordered by the second place, so that a shorter text's
    probes come first; and how many probes lie below each place."""
    second = [np.arange(p, n, p) for p in range(1, n)]
    period = np.repeat(np.arange(1, n), [len(x) for x in second])
    second = np.concatenate(second)
    order = np.lexsort((period, second))
    return period[order], second[order], np.searchsorted(second[order], np.arange(n + 1))


_PERIOD, _SECOND, _BELOW = _listed(_SHORT)
_FIRST = _SECOND - _PERIOD


def word_ids(words: list) -> np.ndarray:
    """Equal words get equal numbers, in order of their first place."""
    numbers = defaultdict(count().__next__)
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def _probes(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of equal words at jp and (j+1)p for the periods low to high-1, ordered."""
    n = len(w)
    if n <= _SHORT:
        probes = _BELOW[n]
        hit = np.flatnonzero(w[_FIRST[:probes]] == w[_SECOND[:probes]])
        hit = hit[_PERIOD[hit] < high]
        period, at = _PERIOD[hit], _FIRST[hit]
        order = np.lexsort((at, period))
        return period[order], at[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if high - low < n // low:  # fewer periods than multiples: one comparison for each period
        for p in range(low, high):
            at = np.flatnonzero(w[: n - p : p] == w[p::p]) * p
            if len(at):
                found.append((np.full(len(at), p), at))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    for j in range((n - 1) // low):
        top = min(high - 1, (n - 1) // (j + 1))
        here = w[j * low : j * top + 1 : j] if j else w[0]
        p = np.flatnonzero(here == w[(j + 1) * low : (j + 1) * top + 1 : j + 1]) + low
        if len(p):
            found.append((p, p * j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    period, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((at, period))
    return period[order], at[order]


def _agree(padded: np.ndarray, period: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether three words on one side of a probe agree too; each run of 12 words or more has such a side (at least six
    places of it agree in a row)."""
    out = np.zeros(len(at), bool)
    for step in (1, -1):
        live = np.arange(len(at))
        for d in range(step, (_EDGE + 1) * step, step):
            here = at[live] + (_EDGE + d)
            live = live[padded[here] == padded[here + period[live]]]
        out[live] = True
    return out


def _extent(a: np.ndarray, b: np.ndarray) -> int:
    """How many places a and b agree from the start, by chunks that double."""
    at, chunk = 0, 64
    while at < len(a):
        differ = a[at : at + chunk] != b[at : at + chunk]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, chunk = at + len(differ), chunk * 2
    return at


def find_runs(w: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal run of max(least, 2 periods) words or more, by start and period.

    least: 12 or more, since a probe's neighbours are looked at first.
    """
    if least < 12:
        raise ValueError("runs of fewer than 12 words are beyond the probes' neighbour test")
    n = len(w)
    if n < least:
        return []
    padded = np.concatenate([np.arange(-1, -1 - _EDGE, -1), w, np.arange(-1 - _EDGE, -1 - 2 * _EDGE, -1)]).astype(np.int32)
    cover_end, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    found: dict[tuple[int, int], int] = {}
    low, high = 1, n if n <= _SHORT else math.isqrt(n) + 1
    while low <= n // 2:
        high = min(high, n // 2 + 1)
        period, at = _probes(w, low, high)
        if len(at):
            open_ = (at + period >= cover_end[at]) | (period % cover_period[at] != 0)
            period, at = period[open_], at[open_]
            alike = _agree(padded, period, at)
            period, at = period[alike], at[alike]
        last, past = 0, 0
        for p, i in zip(period.tolist(), at.tolist()):
            if p == last and i < past or i + p < cover_end[i] and p % cover_period[i] == 0:
                continue
            last, past = p, i + _extent(w[i : n - p], w[i + p :])
            start = i - _extent(w[:i][::-1], w[p : p + i][::-1])
            end = past + p
            if end - start >= max(least, 2 * p) and (start, end) not in found:  # an earlier one has a period that divides p
                found[start, end] = p
                under = cover_end[start:end] < end
                cover_end[start:end][under] = end
                cover_period[start:end][under] = p
        low, high = high, 2 * high
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (the text with one period of
    each run left, words joined by one space) for each row of docs.

    Words are what white space (space, tab to carriage return) parts. A null or empty text has no words, no runs and an
    empty collapsed text. Repeated rows and null ids stay, each on its own; other columns are ignored, whatever their
    names; an empty table gives no rows. A task holds one Arrow batch and the words of one text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "runs", "collapsed"]
        types = [pa.int64(), pa.int64(), _RUNS, pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_buffer() or b"").to_pybytes().split() if text.as_buffer() else []
                runs = find_runs(word_ids(words), least)
                left = b" ".join(kept_words(words, runs)).decode()
                rows.append((doc, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], left))
                held += len(left) + 64 * len(runs)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(work, SCHEMA)
