"""The best k of each query within a task: tiles of scores go in, k rows a query stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores, or parts of scores, that a task holds at once; and rows of a table that it gives out at once.
TILE, ROWS = 1 << 20, 1 << 16


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as Spark and SQL round: halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits, x) + 0.0


class Best:
    """For each of n queries the k rows of highest score; ties: the smaller key, null first."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.held, self.least = k, np.full(n, -np.inf), [], 0, 4 * n * k + TILE // 4

    def add(self, queries: np.ndarray, keys: pa.Array, score: np.ndarray) -> None:
        """score: a row for each of the queries, a column for each key; -inf: no hit."""
        least = self.floor[queries]
        if score.shape[1] > self.k:
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        self.parts.append((queries[i].astype("i4"), keys.take(pa.array(j)), score[i, j]))
        self.held += len(i)
        if self.held > self.least:
            self.prune()

    def prune(self) -> None:
        if not self.parts:
            return
        q, score = np.concatenate([x[0] for x in self.parts]), np.concatenate([x[2] for x in self.parts])
        keys = pa.concat_arrays([x[1] for x in self.parts])
        order = pc.sort_indices(pa.table({"q": q, "s": score, "k": keys}), sort_keys=[("q", "ascending"), ("s", "descending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = score[order[last]]
        order, q = order[place < self.k], q[place < self.k]
        self.parts, self.held = [(q, keys.take(pa.array(order)), score[order])], len(q)

    def rows(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """(queries, keys, scores), ROWS at a time."""
        self.prune()
        for q, keys, score in self.parts:
            for at in range(0, len(q), ROWS):
                yield pa.array(q[at : at + ROWS], pa.int32()), keys.slice(at, ROWS), pa.array(score[at : at + ROWS])
