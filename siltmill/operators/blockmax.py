"""Exact best-k BM25 that leaves out blocks of documents which cannot hold a hit.

Documents fall into blocks in the order in which tasks read them. For each term a block's largest term frequency and
shortest document bound what the term can give there, whatever the collection's statistics. A query reads the blocks of
highest bound first; the k-th score found there is a threshold, and of the other blocks only those whose bound reaches it are
read. Bounds and scores are summed in the tasks that read the blocks, so neither postings nor pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .best import TILE, Best, half_up
from .retrieval import BROADCAST_ROWS, HeldTerms, Index, Tokenize, _lists, _weighted, held_terms, query_terms, saturation, top_k

Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class BlockIndex:
    """blocks: a row for each document (block, key, terms, tfs, lens); the first row of a block also has the block's bounds:
    for each term (bound_terms) the largest tf (most) and the shortest length (least); elsewhere these are empty."""

    index: Index
    blocks: DataFrame


def block_index(index: Index, size: int = 32, keep: Keep = lambda df, _: df) -> BlockIndex:
    """Blocks of at most `size` documents. keep(df, name) stores them. Postings are grouped by document only where the index
    has no documents, or several for one key."""
    key, d = index.key, index.documents
    if d is None or not d.groupBy(key).count().where("count > 1").isEmpty():
        rows = index.postings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "tf", "doc_len"))).alias("_p")).sortWithinPartitions(key)
        rows = rows.select(key, F.col("_p.term").alias("terms"), F.col("_p.tf").cast("array<int>").alias("tfs"), F.col("_p.doc_len").cast("array<int>").alias("lens"))
    else:
        rows = d.select(key, "terms", "tfs", F.array_repeat("doc_len", F.size("terms")).alias("lens"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), 16 * size):
                some = batch.slice(at, 16 * size)
                places = np.arange(len(some)) // size
                yield pa.RecordBatch.from_arrays([pa.array(number + places), *some.columns, *_bounds(some, places, size)], names)
                number += int(places[-1]) + 1

    kind = rows.schema[key].dataType.simpleString()
    names = ["block", key, "terms", "tfs", "lens", "bound_terms", "most", "least"]
    blocks = rows.mapInArrow(deal, f"block long, {key} {kind}, terms array<string>, tfs array<int>, lens array<int>, bound_terms array<string>, most array<int>, least array<int>")
    return BlockIndex(index, keep(blocks, "blocks"))


def _bounds(rows: pa.RecordBatch, block: np.ndarray, size: int) -> list[pa.Array]:
    """bound_terms, most and least of the blocks that the rows are in. A term that one document has in several rows stands as
    often, so that the sum of its bounds holds."""
    _, doc = _lists(rows["terms"])
    tf, length = rows["tfs"].flatten().to_numpy(), rows["lens"].flatten().to_numpy()
    coded = rows["terms"].flatten().dictionary_encode()
    n, code = max(1, len(coded.dictionary)), coded.indices.to_numpy().astype("i8")
    order = np.lexsort((-tf, doc * n + code))
    cell = (doc * n + code)[order]
    again = np.arange(len(cell)) - np.searchsorted(cell, cell)
    times = int(again.max(initial=0)) + 1
    group = (block[doc[order]] * n + code[order]) * times + again
    by = np.argsort(group, kind="stable")
    group, order = group[by], order[by]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    held = np.zeros(len(rows), "i8")
    held[::size] = np.bincount(group[starts] // (n * times), minlength=len(held[::size]))
    ends = pa.array(np.concatenate([[0], np.cumsum(held)]).astype("i4"))
    of = lambda f, x: pa.array(f.reduceat(x[order], starts).astype("i4") if len(starts) else [], pa.int32())
    terms = coded.dictionary.take(pa.array(group[starts] // times % n))
    return [pa.ListArray.from_arrays(ends, v) for v in (terms, of(np.maximum, tf), of(np.minimum, length))]


@dataclass(frozen=True)
class _Sums:
    """Sums over the held terms that rows have: of documents their scores, of blocks their bounds."""

    held: HeldTerms
    k1: float
    b: float

    def found(self, terms: pa.Array, tfs: pa.Array, lens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, term and weight of the terms that are held, and for each row how many parts its sums have."""
        code = pc.index_in(terms.flatten(), pa.array(self.held.terms, pa.string())).fill_null(-1).to_numpy().astype("i8")
        at = np.flatnonzero(code >= 0)
        row, code = _lists(terms)[1][at], code[at]
        tf, length = (x.flatten().to_numpy()[at].astype("f8") for x in (tfs, lens))
        weight = half_up(saturation(tf, length, self.held.average, self.k1, self.b), 5)
        return row, code, weight, np.bincount(row, self.held.first[code + 1] - self.held.first[code], len(terms))

    def add(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """n rows of sums, a column for each query; -inf where nothing is summed. wanted: which sums (row, query) count."""
        first, queries = self.held.first, len(self.held.ids)
        each = first[code + 1] - first[code]
        at = np.repeat(first[code] - np.cumsum(each) + each, each) + np.arange(each.sum())
        cell, part = np.repeat(row, each) * queries + self.held.owner[at], np.repeat(weight, each) * self.held.value[at]
        if wanted is not None:
            cell, part = cell[wanted.ravel()[cell]], part[wanted.ravel()[cell]]
        any_ = np.bincount(cell, minlength=n * queries) > 0
        return np.where(any_, np.bincount(cell, part, n * queries), -np.inf).reshape(n, queries)


def _tiles(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose work is at most TILE, or single rows."""
    done, a = np.cumsum(work), 0
    while a < len(work):
        z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + TILE, "right")))
        yield a, z
        a = z


def _reach(batch: pa.RecordBatch, sums: _Sums) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks whose bounds the batch has, and their bounds: a row for each block, a column for each query."""
    heads = batch.take(pa.array(np.flatnonzero(_lists(batch["bound_terms"])[0])))
    row, code, weight, parts = sums.found(heads["bound_terms"], heads["most"], heads["least"])
    for a, z in _tiles(parts + len(sums.held.ids)):
        lo, hi = np.searchsorted(row, [a, z])
        yield heads["block"].to_numpy()[a:z], sums.add(row[lo:hi] - a, code[lo:hi], weight[lo:hi], z - a)


def block_top(blocks: BlockIndex, queries: DataFrame, k: int, first: int = 8, b: float = 0.75, k1: float = 1.2, tokenize: Tokenize = tokens, keep: Keep = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """(hits, reads): query_id, key, score, rank as the best k of retrieval.bm25 (sparse) gives them, and for each query how
    many blocks hold a term of it (`blocks`) and how many were read (`read`). Ties at the threshold are read.

    first: blocks that a query reads to find its threshold. Queries without hits are in neither. Tasks hold the terms of
    BROADCAST_ROWS (query, term) pairs; more are asked in parts.
    """
    parts = max(1, -(-query_terms(queries, tokenize=tokenize).count() // BROADCAST_ROWS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    done = [_part_top(blocks, queries if parts == 1 else queries.where(part == i), k, first, b, k1, tokenize, keep) for i in range(parts)]
    return reduce(DataFrame.unionByName, [x for x, _ in done]), reduce(DataFrame.unionByName, [x for _, x in done])


def _part_top(blocks: BlockIndex, queries: DataFrame, k: int, first: int, b: float, k1: float, tokenize: Tokenize, keep: Keep) -> tuple[DataFrame, DataFrame]:
    index, key = blocks.index, blocks.index.key
    held = held_terms(_weighted(index, queries, "sparse", 0.0, tokenize)[0])
    rows, n = blocks.blocks if held.ids else blocks.blocks.limit(0), len(held.ids)
    sums, kind, ids = _Sums(held, k1, b), rows.schema[key].dataType.simpleString(), F.broadcast(held.numbered(queries))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, first)
        for batch in batches:
            for block, bound in _reach(batch, sums):
                best.add(np.arange(n), pa.array(block), bound.T)
        for found in best.rows():
            yield pa.RecordBatch.from_arrays(list(found), ["_i", "block", "bound"])

    bounds = rows.select("block", "bound_terms", "most", "least")
    head = top_k(bounds.mapInArrow(highest, "_i int, block long, bound double"), ["_i"], "bound", ["block"], first).select("block", "_i").collect()  # `first` a query
    head.sort()
    head_block, head_query = np.array([r["block"] for r in head], "i8"), np.array([r["_i"] for r in head], "i8")

    def scored(some: DataFrame, least: np.ndarray | None) -> DataFrame:
        """The best k of each query of the blocks in head (least: None), or of the others that reach `least`."""

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, last = Best(n, k), (-1, np.zeros(n, bool))
            for batch in batches:
                block = batch["block"].to_numpy()
                asked = {} if least is None else {x: bound >= least - 1e-6 for at, bounds in _reach(batch, sums) for x, bound in zip(at, bounds)}
                row, code, weight, work = sums.found(batch["terms"], batch["tfs"], batch["lens"])
                for a, z in _tiles(work + 2 * n):
                    own, place = np.unique(block[a:z], return_inverse=True)
                    # a block that was cut off from its bounds by the reader is read for every query
                    wanted = np.array([asked.get(x, last[1] if x == last[0] else np.full(n, least is not None)) for x in own])
                    for i, (lo, hi) in enumerate(zip(np.searchsorted(head_block, own), np.searchsorted(head_block, own, "right"))):
                        wanted[i, head_query[lo:hi]] = least is None
                    lo, hi = np.searchsorted(row, [a, z])
                    if hi > lo and wanted.any():
                        score = half_up(sums.add(row[lo:hi] - a, code[lo:hi], weight[lo:hi], z - a, wanted[place]), 6)
                        best.add(np.arange(n), batch[key].slice(a, z - a), score.T)
                if len(block):
                    last = int(block[-1]), asked.get(block[-1], last[1] if block[-1] == last[0] else np.full(n, least is not None))
            for found in best.rows():
                yield pa.RecordBatch.from_arrays(list(found), ["_i", key, "score"])

        columns = ["block", key, "terms", "tfs", "lens", *([] if least is None else ["bound_terms", "most", "least"])]
        return top_k(some.select(columns).mapInArrow(search, f"_i int, {key} {kind}, score double"), ["_i"], "score", [key], k)

    spark = rows.sparkSession
    chosen = spark.createDataFrame([(x,) for x in sorted(set(head_block.tolist()))], "block long")
    best = keep(scored(rows.join(F.broadcast(chosen), "block", "left_semi"), None), "block-first")  # `first` blocks a query
    least = np.full(n, -np.inf)
    for r in best.where(F.col("rank") == k).select("_i", "score").collect():  # one row a query
        least[r["_i"]] = r["score"]
    hits = top_k(best.drop("rank").unionByName(scored(rows, least).drop("rank")), ["_i"], "score", [key], k)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, reach = np.zeros(n, "i8"), np.zeros(n, "i8")
        for batch in batches:
            for block, bound in _reach(batch, sums):
                hold += (bound > -np.inf).sum(axis=0)
                high = (bound > -np.inf) & (bound >= least - 1e-6)
                for i, (lo, hi) in enumerate(zip(np.searchsorted(head_block, block), np.searchsorted(head_block, block, "right"))):
                    high[i, head_query[lo:hi]] = True
                reach += high.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(hold), pa.array(reach)], ["_i", "blocks", "read"])

    reads = bounds.mapInArrow(counted, "_i int, blocks long, read long").groupBy("_i").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read")).where("blocks > 0")
    named: Callable[[DataFrame], DataFrame] = lambda df: df.join(ids, "_i").drop("_i")
    return named(hits).select("query_id", key, "score", "rank"), named(reads).select("query_id", "blocks", "read")
