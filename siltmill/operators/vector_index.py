"""An inverted-file index of vectors: cells around centroids, one folder of files for each cell.

A search reads the folders of the cells that its queries probe and no others. The nearest cells give good neighbours; with
`exact`, every further cell that could hold a better one is read too: a vector's angle to a query is at least the angle
between query and centroid less the cell's radius.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .best import TILE, Best
from .retrieval import QUERY_BYTES, dense_top, nearest, top_k, unit
from .retrieval import matrix as vectors_of

#: Vectors that the cells are fitted on, at most about so many, by a hash of the key; and cells, at most.
SAMPLE, CELLS = 50_000, 4096
#: Vectors that a recall is measured on when an index is built.
TRIALS = 200


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.map(np.asarray).to_list()).astype("f8")


def closest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each unit vector and the cosine, TILE of them at a time."""
    own, near = np.zeros(len(v), "i8"), np.zeros(len(v))
    for at in range(0, len(v), step := max(1, TILE // len(c))):
        score = v[at : at + step] @ c.T
        own[at : at + step], near[at : at + step] = score.argmax(axis=1), score.max(axis=1)
    return own, near


def _centroids(cells: int, rounds: int):
    """Spherical k-means of the sample; an empty cell takes the vector that lies farthest from its own."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = unit(matrix(pdf.sort_values("_order")["embedding"]))
        c = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)].copy()
        for _ in range(rounds):
            own, near = closest(v, c)
            sums = np.zeros_like(c)
            np.add.at(sums, own, v)
            far = iter(np.argsort(near, kind="stable").tolist())
            for empty in np.flatnonzero(np.bincount(own, minlength=len(c)) == 0):
                sums[empty] = v[next(far)]
            c = unit(sums)
        return pd.DataFrame({"cell": np.arange(len(c), dtype="i4"), "centroid": c.tolist()})

    return fit


def build(vectors: DataFrame, folder: str, key: str = "vec_id", cells: int | None = None, sample: int = SAMPLE, rounds: int = 6, recall: float = 0.93) -> None:
    """Writes the index of vectors (key, embedding; one row a key) to a folder: `vectors`, by cell, and `cells` (cell, n,
    centroid, least cosine of a member). Rows with a null embedding are left out. Cells: about the square root of the
    vectors, at most CELLS. Every vector is indexed; only the cells' places are fitted on a sample. The cells that a search
    probes by default are as many as give `recall` of the true ten nearest on trials (`probes`)."""
    rows = vectors.select(key, "embedding").where("embedding is not null")
    n = rows.count()
    spark = vectors.sparkSession
    kind = dict(rows.dtypes)[key]
    if not n:
        rows.withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{folder}/vectors")
        spark.createDataFrame([], "cell int, n long, least double, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/cells")
        spark.createDataFrame([(1,)], "probes int").write.mode("overwrite").parquet(f"{folder}/probes")
        return
    order = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    some = rows.withColumn("_order", order).where(F.col("_order") <= int(min(1.0, sample / n) * (1 << 31))).select("_order", "embedding")
    if some.isEmpty():  # a tiny table whose hashes all lie high
        some = rows.withColumn("_order", order).select("_order", "embedding").limit(sample)
    found = some.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_centroids(cells or max(1, min(CELLS, round(math.sqrt(n)))), rounds), "cell int, centroid array<double>")
    held = found.orderBy("cell").collect()  # at most CELLS rows
    c = np.array([r["centroid"] for r in held])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                own, near = closest(unit(matrix(pdf["embedding"])), c)
                yield pdf.assign(cell=own.astype("i4"), near=near)

    placed = rows.mapInPandas(place, f"{key} {kind}, embedding {dict(rows.dtypes)['embedding']}, cell int, near double")
    # by ranges of cell and key: a cell with a third of all vectors is several tasks and files
    placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    sizes = spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    places = spark.createDataFrame([(r["cell"], r["centroid"]) for r in held], "cell int, centroid array<double>")
    sizes.join(F.broadcast(places), "cell").write.mode("overwrite").parquet(f"{folder}/cells")
    spark.createDataFrame([(_probes(rows, _opened(spark, folder, key, 1), key, recall),)], "probes int").write.mode("overwrite").parquet(f"{folder}/probes")


def _probes(rows: DataFrame, index: VectorIndex, key: str, recall: float) -> int:
    """How many cells give the recall: of the true ten nearest of TRIALS vectors (by hash; none counts as its own
    neighbour), the cells' places in the order of each trial's cells."""
    first = rows.withColumn("_order", F.xxhash64(key)).orderBy("_order", key).limit(TRIALS)
    trials = first.select(F.col(key).alias("query_id"), F.col("embedding").alias("q"))
    near = dense_top(rows, trials, key, 11).where(F.col("query_id") != F.col(key)).join(index.rows().select(key, "cell"), key)
    held = {r["query_id"]: r["q"] for r in trials.collect()}
    at = {c: i for i, c in enumerate(index.cells.tolist())}
    order = index.probed(unit(np.array(list(held.values()), "f8")), len(index.cells))
    place = dict(zip(held, np.argsort(order, axis=1, kind="stable")))
    ranks = [int(place[r["query_id"]][at[r["cell"]]]) for r in near.select("query_id", "cell").collect()]
    return 1 + int(np.quantile(ranks, recall, method="higher")) if ranks else 1


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    key: str
    kind: str
    cells: np.ndarray  # numbers of the cells that hold vectors
    sizes: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray  # largest angle of a member
    probes: int = 1

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """For each unit query the positions of its nearest cells."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def read(self, wanted: dict[int, np.ndarray], q: np.ndarray, k: int) -> DataFrame:
        """_i, key, score: for each cell's queries (positions in q) the best k of each task."""
        key = self.key

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(q), k)
            for batch in batches:
                cell, v = batch["cell"].to_numpy(), unit(vectors_of(batch["embedding"]))
                for one in np.unique(cell):
                    at = np.flatnonzero(cell == one)
                    nearest(best, wanted[int(one)], q, batch[key].take(pa.array(at)), v[at])
            for found in best.rows():
                yield pa.RecordBatch.from_arrays(list(found), ["_i", key, "score"])

        some = self.rows().where(F.col("cell").isin(sorted(wanted))).select(key, "embedding", "cell")
        return some.mapInArrow(search, f"_i int, {key} {self.kind}, score double")


def open_index(spark: SparkSession, folder: str, key: str = "vec_id") -> VectorIndex:
    probes = spark.read.parquet(f"{folder}/probes").first()[0]
    return _opened(spark, folder, key, probes)


def _opened(spark: SparkSession, folder: str, key: str, probes: int) -> VectorIndex:
    held = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # at most CELLS rows
    least = np.clip([r["least"] for r in held], -1, 1)
    kind = dict(spark.read.parquet(f"{folder}/vectors").dtypes)[key]
    cells, sizes = np.array([r["cell"] for r in held], "i8"), np.array([r["n"] for r in held], "i8")
    return VectorIndex(spark, folder, key, kind, cells, sizes, np.array([r["centroid"] for r in held]), np.arccos(least) + 1e-7, probes)


def _by_cell(index: VectorIndex, pairs: np.ndarray) -> dict[int, np.ndarray]:
    """Cell number to the queries of pairs (query, position of a cell)."""
    pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
    at, first = np.unique(pairs[:, 1], return_index=True)
    return {int(index.cells[p]): own for p, own in zip(at, np.split(pairs[:, 0], first[1:]))}


def _search(index: VectorIndex, held: list, kind: StructField, k: int, probes: int, exact: bool) -> DataFrame:
    q = unit(np.array([r["q"] for r in held], "f8"))
    probes = min(probes, len(index.cells))
    near = index.probed(q, probes)
    pairs = np.column_stack([np.repeat(np.arange(len(q)), probes), near.ravel()])
    best = top_k(index.read(_by_cell(index, pairs), q, k), ["_i"], "score", [index.key], k)
    if exact and probes < len(index.cells):
        last = np.full(len(q), -2.0)
        for r in best.groupBy("_i").agg(F.min("score").alias("s"), F.count("*").alias("n")).collect():  # a row for each query of the block
            if r["n"] == k:
                last[r["_i"]] = r["s"]
        bound = np.cos(np.maximum(0, np.arccos(np.clip(q @ index.centroids.T, -1, 1)) - index.radii[None, :]))
        open_ = bound >= last[:, None] - 1e-6
        np.put_along_axis(open_, near, True, axis=1)  # the first cells again, so that one plan gives all
        best = top_k(index.read(_by_cell(index, np.argwhere(open_)), q, k), ["_i"], "score", [index.key], k)
    ids = index.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(held)], StructType([StructField("_i", IntegerType()), kind]))
    return best.join(F.broadcast(ids), "_i").select("query_id", index.key, "score", "rank")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, key, score (6 decimals), rank of the k nearest vectors by cosine for queries (query_id, q).

    The nearest `probes` cells of each query are read (by default those that reached the recall in trials); with exact, also all cells that could hold a better vector, which
    gives the same rows as retrieval.dense_top. Queries go in blocks of QUERY_BYTES (vectors and the cells that each may
    probe); several blocks are answered one after the other into a table of the index's folder.
    """
    spark, probes = index.spark, probes or index.probes
    empty = spark.createDataFrame([], StructType([queries.schema["query_id"], index.rows().schema[index.key]])).withColumns({"score": F.lit(0.0), "rank": F.lit(0).cast("long")})
    n, size = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    if not n or not len(index.cells):
        return empty
    blocks = math.ceil(n * (8 * size + 8 * len(index.cells)) / QUERY_BYTES)
    kind = queries.schema["query_id"]
    if blocks == 1:
        return _search(index, queries.select("query_id", "q").collect(), kind, k, probes, exact)
    path = f"{index.folder}/found-{uuid.uuid4().hex}"
    for b in range(blocks):
        if held := queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "q").collect():
            _search(index, held, kind, k, probes, exact).write.mode("append").parquet(path)
    return spark.read.parquet(path)
