"""Sharding by Karmarkar-Karp differencing.

Rows of equal text are one indivisible group. Groups fall into blocks of bounded size by a hash of their content; each
block is solved by repeatedly combining the two partial partitions of largest spread, oppositely ordered. The blocks'
results are partial partitions too, so blocks of blocks combine in the same way until one is left.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, stored


def difference(items: list[list[int]]) -> list[list[int]]:
    """items: k sums each (bin 0 to k-1). Returns for each item the common bin that each of its bins falls into."""
    k = len(items[0])
    heap: list[tuple[int, int]] = []
    sums: list[list[int]] = []
    order: list[list[int]] = []  # node: which bin of its own (leaf) or position pair (inner) stands at each position, largest sum first
    kids: list[tuple[int, int] | None] = []
    for i, s in enumerate(items):
        at = sorted(range(k), key=lambda b: -s[b])
        sums.append([s[b] for b in at])
        order.append(at)
        kids.append(None)
        heap.append((sums[i][-1] - sums[i][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        at = sorted(range(k), key=both.__getitem__, reverse=True)
        sums[a] = sums[b] = []
        sums.append([both[p] for p in at])
        order.append(at)
        kids.append((a, b))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(kids) - 1))
    out: list[list[int]] = [[0] * k for _ in items]
    stack = [(heap[0][1], list(range(k)))]  # node, the final bin of each of its positions
    while stack:
        node, final = stack.pop()
        if (pair := kids[node]) is None:
            for position, own in enumerate(order[node]):
                out[node][own] = final[position]
            continue
        left = [0] * k
        for position, p in enumerate(order[node]):
            left[p] = final[position]
        stack.append((pair[0], left))
        stack.append((pair[1], left[::-1]))
    return out


def _solve_groups(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True])
        return pdf.assign(bin=[m[0] for m in difference([[int(b)] + [0] * (k - 1) for b in pdf["bytes"]])])

    return solve


def _solve_blocks(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="block", columns="bin", values="bytes").reindex(columns=range(k)).fillna(0).astype("int64").sort_index()
        maps = difference(table.to_numpy().tolist())
        rows = [(b, own, to, int(pdf["parent"].iloc[0]), int(table.at[b, own])) for b, m in zip(table.index, maps) for own, to in enumerate(m)]
        return pd.DataFrame(rows, columns=["block", "bin", "to", "parent", "bytes"])

    return solve


def shard_by_bytes(docs: DataFrame, shards: int = 24, block_groups: int = 20_000, fan_in: int = 500, chunk_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row of docs.

    size: UTF-8 bytes of the text plus 8 (null: 8). All rows of one text share a shard; null texts are one group, empty
    texts another. A group larger than a shard's share makes that shard as much larger. slot counts a shard's rows from
    0 without gaps, in an order without meaning. Repeated rows and null ids stay; other columns are ignored; an empty
    table gives no rows. block_groups and fan_in bound what one task solves, chunk_rows what one task numbers.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    rows = stored(docs.select("doc_id", digest().alias("digest"), size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32")), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    n_rows, n_groups = rows.agg(F.count("*"), F.approx_count_distinct("digest")).first()
    blocks = max(1, math.ceil(n_groups / block_groups))
    solved = groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks))).groupBy("block").applyInPandas(_solve_groups(shards), "digest binary, bytes long, block long, bin int")
    solved = stored(solved, "shard-groups")
    sums, path, n = solved.groupBy("block", "bin").agg(F.sum("bytes").alias("bytes")), solved.select("digest", "block", "bin"), blocks
    while n > 1:
        up = max(1, math.ceil(n / fan_in))
        level = sums.withColumn("parent", F.col("block") % up).groupBy("parent").applyInPandas(_solve_blocks(shards), "block long, bin int, to int, parent long, bytes long")
        level = stored(level, "shard-level")
        path = path.join(level.select("block", "bin", "to", "parent"), ["block", "bin"]).select("digest", F.col("parent").alias("block"), F.col("to").alias("bin"))
        sums = level.groupBy(F.col("parent").alias("block"), F.col("to").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        n = up
    chunks = max(1, math.ceil(n_rows / shards / chunk_rows))
    placed = rows.join(path.select("digest", F.col("bin").alias("shard")), "digest").withColumn("chunk", F.pmod(F.xxhash64("digest", "doc_id"), F.lit(chunks)))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(before, F.lit(0))).drop("n")
    numbered = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "digest")))
    return numbered.join(starts, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
