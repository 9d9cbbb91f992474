"""Citation and reading-order graph: edges(src, dst, rel) as tables, hops as equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import PUBLIC, visible
from .retrieval import small


def heads(units: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The unit that a reference means: the lowest part, the earliest on a tie."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return units.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve(refs: DataFrame, head_units: DataFrame, keys: list[str], src: str, dst: str, rel: Column) -> DataFrame:
    """Edges from references to the head units they name; none from a unit to itself."""
    return refs.join(head_units, keys).where(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst"), rel.alias("rel"))


def one_relation(edges: DataFrame, priority: dict[str, int], order: str = "ord") -> DataFrame:
    """One edge for each pair: the relation of highest priority (smallest number), then the first."""
    rank = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy("src", "dst").orderBy(F.coalesce(rank[F.col("rel")], F.lit(99)), order, "rel")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_edges(units: DataFrame, keys: list[str], order: list[str], unit: str, number: str, part: str | None = None) -> DataFrame:
    """src, dst: a unit and the next one in reading order, if it is the next part or the next number (never from 0)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n, nn = F.col(number), F.lead(number).over(w)
    step = (nn == n + 1) & (n != 0)
    if part:
        step = step | ((nn == n) & (F.lead(part).over(w) == F.col(part) + 1))
    return units.select(F.col(unit).alias("src"), F.lead(unit).over(w).alias("dst"), step.alias("_ok")).where("_ok").drop("_ok")


def successors(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """seed, dst: each value of the integer `order` and the next one of the same keys.

    Rows are numbered within blocks of `block` values, and blocks are joined by their ends, so a key that holds most
    rows is not one task.
    """
    b = df.select(*keys, F.col(order).alias("seed"), F.floor(F.col(order) / block).alias("_b"))
    inside = b.withColumn("dst", F.lead("seed").over(Window.partitionBy(*keys, "_b").orderBy("seed"))).where("dst is not null").select("seed", "dst")
    ends = b.groupBy(*keys, "_b").agg(F.max("seed").alias("seed"), F.min("seed").alias("_first"))
    over = ends.withColumn("dst", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b"))).where("dst is not null").select("seed", "dst")
    return inside.unionByName(over)


def both_ways(next_section: DataFrame) -> DataFrame:
    """Two ADJACENT_SECTION edges, next and previous, for each reading-order edge."""
    fwd = next_section.select("src", "dst", F.lit("next").alias("direction"))
    back = next_section.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("previous").alias("direction"))
    return fwd.unionByName(back)


def chain(chunks: DataFrame, keys: list[str], order: list[str], unit: str) -> DataFrame:
    """src, dst of consecutive chunks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.select(F.col(unit).alias("src"), F.lead(unit).over(w).alias("dst")).where("dst is not null")


def hop(seeds: DataFrame, edges: DataFrame, seed: str = "seed", rels: list[str] | None = None) -> DataFrame:
    """seeds with the targets of their out-edges: seed's columns, dst, rel."""
    e = edges.where(F.col("rel").isin(rels)) if rels else edges
    return seeds.join(e, F.col(seed) == F.col("src")).drop("src")


def expand(seeds: DataFrame, edges: DataFrame, per_seed: int, first: str = "EMPOWERED_BY", seed: str = "seed") -> DataFrame:
    """seed, dst, rel, ord: the first per_seed targets of each seed, those of relation `first` before the others."""
    got = hop(seeds.select(seed), edges.select("src", "dst", "rel"), seed).distinct()
    order = Window.partitionBy(seed).orderBy((F.col("rel") != first).cast("int"), "rel", "dst")
    return got.withColumn("ord", F.row_number().over(order).cast("long")).where(F.col("ord") <= per_seed)


def adjacency(edges: DataFrame) -> DataFrame:
    """Different (src, dst) pairs of edges read in both directions."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def subordinates(seeds: DataFrame, edges: DataFrame, doc_of: DataFrame) -> DataFrame:
    """In-edges from other documents: seed, src, src_doc, rel (the greatest of a pair's relations)."""
    d = doc_of.select(F.col("unit").alias("src"), F.col("doc").alias("src_doc"))
    s = doc_of.select(F.col("unit").alias("seed"), F.col("doc").alias("seed_doc"))
    hits = seeds.join(edges, F.col("seed") == F.col("dst")).join(d, "src").join(s, "seed").where("src_doc <> seed_doc")
    return hits.groupBy("seed", "src", "src_doc").agg(F.max("rel").alias("rel"))


def related(parts: dict[str, DataFrame]) -> DataFrame:
    """Labelled union of neighbour tables (seed, dst)."""
    return reduce(DataFrame.unionByName, [df.select("seed", "dst", F.lit(k).alias("relation")) for k, df in parts.items()])


#: Bytes of a title that are looked up in texts, and bits of the filter that texts' bytes pass first (2 MB).
GRAM, GRAM_BITS = 8, 1 << 24
GRAM_ROWS = 200_000  # runs that a task holds before it hands them on
GRAM_BYTES = 1 << 20  # of texts that are cut into runs at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _windows(raws: list[bytes], size: int, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place in raws, run) of the different runs of `size` bytes (8 at most) of each, as numbers; held: only those whose bit
    is set. All are cut at once."""
    b = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    n = max(0, len(b) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out |= b[i : i + n] << np.uint64(8 * i)
    whole = owner[:n] == owner[len(owner) - n :]
    if held is not None:
        whole &= held[_bit(out)]
    owner, out = owner[:n][whole], out[whole]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    return owner[new], out[new]


def _bit(grams: np.ndarray) -> np.ndarray:
    return ((grams * _SPREAD) >> np.uint64(40)) % np.uint64(GRAM_BITS)


def _grams(df: DataFrame, key: str, text: str, sizes: list[int], most: int, bits: bytes | None = None) -> DataFrame:
    """key, size, gram, bit: the different byte runs of each text, copies of a row perhaps once. sizes: those asked for; texts of fewer than `most` bytes
    give themselves only (sizes empty). bits: runs whose bit is not set are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool) if bits is not None else None
        found: list[pd.DataFrame] = []
        copies: set[tuple] = set()
        keys, raws, size, n = [], [], 0, 0
        for pdf in parts:
            for k, t in zip(pdf[key], pdf[text]):
                if (k, hash(t)) in copies:  # the same rows again
                    continue
                copies.add((k, hash(t)))
                keys.append(k)
                raws.append((t or "").encode())
                size += len(raws[-1])
                if size > GRAM_BYTES:
                    found += cut(keys, raws, held)
                    keys, raws, size, n = [], [], 0, sum(map(len, found))
                if n > GRAM_ROWS:
                    yield pd.concat(found)
                    found, n = [], 0
                if len(copies) > GRAM_ROWS:
                    copies.clear()
        found += cut(keys, raws, held)
        if found:
            yield pd.concat(found)

    def cut(keys: list, raws: list[bytes], held: np.ndarray | None) -> Iterator[pd.DataFrame]:
        for n in sizes or sorted({min(len(r), most) for r in raws} - {0}):
            some = range(len(raws)) if sizes else [i for i, r in enumerate(raws) if min(len(r), most) == n]
            at, grams = _windows([raws[i] for i in some], n, held)
            if len(grams):
                yield pd.DataFrame({key: np.array([keys[i] for i in some])[at], "size": np.full(len(at), n, np.int32), "gram": grams.view(np.int64), "bit": _bit(grams).astype(np.int64)})

    rows = df.select(F.col(key), F.col(text))
    return rows.mapInPandas(run, StructType([df.schema[key], *StructType.fromDDL("size int, gram long, bit long").fields]))


def _flags(grams: DataFrame) -> bytes:
    """The filter with the bits (bit) of grams set; at most GRAM_BITS / 64 rows come to the driver."""
    flags = np.zeros(GRAM_BITS // 64, "<i8")
    for w, v in grams.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v")).collect():
        flags[w] = v
    return flags.tobytes()


def link_titles(cases: DataFrame, documents: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """case_id, doc_id where the case's text (text) holds the document's whole title (title), for each row of both.

    Blank titles and null texts match nothing. Of each title's runs of GRAM bytes (a shorter title is one run) the one that
    fewest texts hold is joined to the texts that hold it, and each pair is verified by containment. Texts are cut twice, by
    filters of GRAM_BITS: first to count the runs that titles may have, in the tasks, then for the chosen runs alone. Texts
    that are in no pair are left out before any is shuffled; no title and no text comes to the driver. keep(df, name) may
    store a table that is read twice.
    """
    named = documents.where("trim(title) <> ''").select("doc_id", "title")
    titles = named.select("title").distinct().withColumn("tid", F.xxhash64("title"))
    own = keep(_grams(titles, "tid", "title", [], GRAM), "title-grams")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most GRAM
    texts = cases.select("case_id", "text", F.xxhash64("text").alias("_row")).where("text is not null")
    cut = lambda grams: _grams(texts, "_row", "text", sizes or [GRAM], GRAM, _flags(grams))
    often = cut(own).groupBy("size", "gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, ["size", "gram"], "left").groupBy("tid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram", "bit")).alias("_g"))
    chosen = keep(rarest.where("_g.n > 0").select("tid", "_g.size", "_g.gram", "_g.bit"), "title-chosen")
    seen = cut(chosen).select("_row", "size", "gram")
    pairs = keep(seen.join(chosen, ["size", "gram"]).select("_row", "tid").distinct(), "title-pairs")  # copies of a text meet in its digest
    some = texts.join(small(pairs.select("_row").distinct(), pairs.count()), "_row", "left_semi")
    held = some.join(pairs.join(titles, "tid"), "_row").where(F.contains("text", "title"))
    return held.join(named, "title").select("case_id", "doc_id")


def faq_links(titles: DataFrame, citations: DataFrame) -> DataFrame:
    """case_id, dst (as text), rel: cases relate to documents whose whole title they hold (case_id, doc_id) and cite the
    units that they name (case_id, dst); each link once."""
    a = titles.select("case_id", F.col("doc_id").cast("string").alias("dst"), F.lit("RELATES_TO_LAW").alias("rel"))
    b = citations.select("case_id", F.col("dst").cast("string").alias("dst"), F.lit("CITES").alias("rel"))
    return a.unionByName(b).distinct()


def related_cases(links: DataFrame, cases: DataFrame, org: str, preview: int = 80) -> DataFrame:
    """chunk, case_id, question of FAQ cases (case_id, org_id or null for public, question) that relate to a chunk (links:
    case_id, chunk) and that the tenant may read."""
    open_ = cases.withColumn("org_id", F.coalesce("org_id", F.lit(PUBLIC)))
    return links.join(visible(open_, org), "case_id").select("chunk", "case_id", F.substring("question", 1, preview).alias("question"))
