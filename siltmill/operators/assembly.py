"""From recalled candidates to the final list: rerank, threshold, slots, neighbours, FAQ."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import visible
from .models import PairModel, score_pairs
from .retrieval import Index, Tokenize, bm25, bm25_top, dense_top, rrf, small, top_k


@dataclass(frozen=True)
class RetrieverConfig:
    search_top_k: int = 40
    seeds: int = 40
    per_query: int = 4
    top_k: int = 15
    graph_per_seed: int = 2
    rrf_k: int = 60
    threshold: float = float("-inf")
    rank_by: str = "primary"  # or "max"
    faq_k: int = 2
    graph_position: str = "after"  # its seed, or "end"
    faq_mode: str = "separate"  # or "mixed"
    rerank_chars: int = 1200


def fuse_variants(ranked: DataFrame, cfg: RetrieverConfig, key: str) -> DataFrame:
    """query_id, key, score over the variants' merged lists (query_id, variant_id, key, rank), best first: `rank`."""
    return top_k(rrf([ranked], key, cfg.rrf_k), ["query_id"], "score", [key], cfg.seeds)


def rerank(scored: DataFrame, key: str, rank_by: str = "primary") -> DataFrame:
    """query_id, key, final (variant 0's score, or the best), best, best_variant from (query_id, variant_id, key, score)."""
    top = F.max(F.struct("score", (-F.col("variant_id")).alias("v")))
    g = scored.groupBy("query_id", key).agg(top.alias("_b"), F.max(F.when(F.col("variant_id") == 0, F.col("score"))).alias("_p"))
    return g.select("query_id", key, (F.col("_b.score") if rank_by == "max" else F.col("_p")).alias("final"), F.col("_b.score").alias("best"), (-F.col("_b.v")).alias("best_variant"))


def passing(df: DataFrame, threshold: float, key: str, score: str = "best") -> DataFrame:
    """Rows at or above the threshold; a query with none keeps its single best row. A row stays for its best score over
    the variants; `final` only orders."""
    w = Window.partitionBy("query_id")
    n = F.row_number().over(w.orderBy(F.col(score).desc(), key))
    top = F.max(score).over(w)
    return df.withColumn("_n", n).withColumn("_top", top).where((F.col(score) >= threshold) | ((F.col("_top") < threshold) & (F.col("_n") == 1))).drop("_n", "_top")


def slots(scored: DataFrame, passed: DataFrame, key: str, cfg: RetrieverConfig) -> DataFrame:
    """Guaranteed slots first: each variant's best `per_query` passing rows in variant order, then by final score; cut at
    max(top_k, per_query x variants); re-sorted by final score. Adds position (from 1)."""
    rows = scored.join(passed.select("query_id", key, "final"), ["query_id", key])
    per = top_k(rows, ["query_id", "variant_id"], "score", [key], cfg.per_query, "_r")
    first = per.groupBy("query_id", key).agg(F.min(F.struct("variant_id", "_r")).alias("_slot"))
    variants = scored.groupBy("query_id").agg(F.countDistinct("variant_id").alias("_nv"))
    all_ = passed.join(first, ["query_id", key], "left").join(variants, "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("_slot.variant_id").asc_nulls_last(), F.col("_slot._r").asc_nulls_last(), F.col("final").desc(), key)
    cut = all_.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.greatest(F.lit(cfg.top_k), cfg.per_query * F.col("_nv")))
    again = Window.partitionBy("query_id").orderBy(F.col("final").desc(), key)
    return cut.withColumn("position", F.row_number().over(again).cast("long")).select("query_id", key, "final", "position")


def carry_neighbours(kept: DataFrame, neighbours: DataFrame, key: str, cfg: RetrieverConfig) -> DataFrame:
    """kept and, after each seed, its first graph_per_seed neighbours (seed, dst, ord) that are not kept and that no
    earlier seed carried; the cut comes before that check. A neighbour scores its seed less 0.001; with graph_position
    `end` it comes after all seeds and scores the lowest of them less 0.001 a place."""
    few = neighbours.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy("ord", "dst"))).where(F.col("_r") <= cfg.graph_per_seed)
    got = kept.select("query_id", F.col(key).alias("seed"), F.col("final").alias("_f"), F.col("position").alias("_p")).join(few, "seed")
    once = got.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "dst").orderBy("_p", "_r"))).where("_n = 1")
    new = once.join(kept.select("query_id", F.col(key).alias("dst")), ["query_id", "dst"], "left_anti")
    final = F.col("_f") - 1e-3
    if cfg.graph_position == "end":
        ends = kept.groupBy("query_id").agg(F.min("final").alias("_least"), F.max("position").alias("_last"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "_r"))
        new = new.withColumn("_i", place).join(ends, "query_id").withColumn("_p", F.col("_last") + F.col("_i"))
        final = F.col("_least") - 1e-3 * F.col("_i")
    rows = kept.select("query_id", key, "final", F.lit("search").alias("origin"), "position", F.lit(0).alias("_r")).unionByName(
        new.select("query_id", F.col("dst").alias(key), F.round(final, 6).alias("final"), F.lit("graph").alias("origin"), F.col("_p").alias("position"), "_r")
    )
    order = Window.partitionBy("query_id").orderBy("position", "_r")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).drop("_r")


def append_faq(kept: DataFrame, faq: DataFrame, key: str, cfg: RetrieverConfig) -> DataFrame:
    """kept and, after it, the first faq_k FAQ rows (query_id, key, rank) that it does not hold already: the i-th scores
    the lowest score (0 where nothing is kept) less 1 and i times 0.001."""
    floor = kept.groupBy("query_id").agg(F.min("final").alias("_floor"), F.max("position").alias("_last"))
    fresh = faq.where(F.col("rank") <= cfg.faq_k).join(kept.select("query_id", key), ["query_id", key], "left_anti")
    fresh = fresh.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    least, last = F.coalesce("_floor", F.lit(0.0)), F.coalesce("_last", F.lit(0))
    tail = fresh.join(floor, "query_id", "left").select("query_id", key, F.round(least - 1 - 1e-3 * F.col("_i"), 6).alias("final"), F.lit("faq").alias("origin"), (last + F.col("_i")).cast("long").alias("position"))
    return kept.unionByName(tail)


def gate(scored: DataFrame, key: str, threshold: float = 0.20, top: int = 5) -> DataFrame:
    """query_id, key, score, rank: rows at the threshold or above, the best `top`; the single best where none passes."""
    return top_k(passing(scored, threshold, key, "score"), ["query_id"], "score", [key], top)


def clean_variants(queries: DataFrame) -> DataFrame:
    """query_id, variant_id, text: repeated texts of a query are dropped, then texts are trimmed and blank ones go;
    variants are numbered anew from 0."""
    first = queries.where("text is not null").groupBy("query_id", "text").agg(F.min("variant_id").alias("variant_id"))
    rows = first.withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("variant_id")) - 1
    return rows.select("query_id", number.cast("int").alias("variant_id"), "text")


def overlap(query_text: Column, chunk_text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of a query's different terms that the chunk has."""
    a, b = F.array_distinct(tokens(query_text)), F.array_distinct(tokens(chunk_text))
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)), 6)


@dataclass(frozen=True)
class Uploads:
    """A tenant's own documents, a collection with its own statistics. chunks: chunk_id, text; vectors: chunk_id, embedding,
    or None."""

    chunks: DataFrame
    index: Index
    vectors: DataFrame | None = None


@dataclass(frozen=True)
class Store:
    """What a search reads. chunks: chunk_id, kind, org_id, text; index: over the chunks' texts; vectors: chunk_id,
    embedding; neighbours: seed, dst, ord; uploads: the asking tenant's."""

    chunks: DataFrame
    index: Index
    vectors: DataFrame
    neighbours: DataFrame
    uploads: Uploads | None = None
    tokenize: Tokenize = tokens


def store_search(store: Store, queries: DataFrame, vectors: DataFrame | None, org: str, k: int, kinds: list[str] | None = None, excluded: list[str] | None = None, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank of hybrid search; tenant and kind filters hold in both legs, before ranking.
    vectors: query_id, q; without any the lexical leg alone is fused."""
    def open_to(rows: DataFrame) -> DataFrame:
        rows = visible(rows, org)
        rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
        return rows.where(~F.col("kind").isin(excluded)) if excluded else rows

    seen = open_to(store.chunks).select("chunk_id")
    depth = max(3 * k, 30)
    if store.index.documents is not None and {"org_id", "kind"} <= set(store.index.documents.columns):
        legs = [bm25_top(store.index, queries, depth, seen=open_to, tokenize=store.tokenize)]
    else:
        legs = [top_k(bm25(store.index, queries, within=seen, tokenize=store.tokenize), ["query_id"], "score", ["chunk_id"], depth)]
    if vectors is not None:
        legs.append(dense_top(store.vectors.join(seen, "chunk_id", "left_semi"), vectors, "chunk_id", depth))
    return top_k(rrf(legs, "chunk_id", rrf_k), ["query_id"], "score", ["chunk_id"], k)


def uploads_search(store: Store, queries: DataFrame, vectors: DataFrame | None, k: int, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank of hybrid search in the tenant's uploads: max(k / 3, 5) for a search of k."""
    own, k = store.uploads, max(k // 3, 5)
    depth = max(3 * k, 30)
    legs = [top_k(bm25(own.index, queries, key="chunk_id", tokenize=store.tokenize), ["query_id"], "score", ["chunk_id"], depth)]
    if vectors is not None and own.vectors is not None:
        legs.append(dense_top(own.vectors, vectors, "chunk_id", depth))
    return top_k(rrf(legs, "chunk_id", rrf_k), ["query_id"], "score", ["chunk_id"], k)


def merged_search(store: Store, queries: DataFrame, vectors: DataFrame | None, org: str, k: int, excluded: list[str] | None = None, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank: the corpus's hits and the uploads' by fused score."""
    hits = store_search(store, queries, vectors, org, k, excluded=excluded, rrf_k=rrf_k)
    if store.uploads is None:
        return hits
    both = hits.unionByName(uploads_search(store, queries, vectors, k, rrf_k)).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order).cast("long"))


def _fused_order(seeds: DataFrame, cfg: RetrieverConfig) -> DataFrame:
    return seeds.where(F.col("rank") <= cfg.top_k).select("query_id", "chunk_id", F.col("score").alias("final"), F.col("rank").alias("position"))


def retrieve(store: Store, queries: DataFrame, vectors: DataFrame | None, org: str, cfg: RetrieverConfig = RetrieverConfig(), scorer: Callable[[Column, Column], Column] | PairModel | None = overlap, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, final, origin, position; one row of stats for each query) of a batch of questions.

    queries: query_id, variant_id, text; vectors: query_id, variant_id, q. Recall for each variant is fused over the
    variants, the seeds are scored against every variant by `scorer`, thresholded, given slots, followed by what they
    cite, and, with faq_mode `separate`, by FAQ cases found for variant 0. Without a scorer the fused order decides, as it
    does for the questions for which a model fails.
    keep(df, name) may store a table that several later stages read.
    """
    v = keep(clean_variants(queries), "variants")
    apart = cfg.faq_mode == "separate"
    pair = F.struct("query_id", "variant_id").alias("query_id")
    asked = v.select(pair, "text")
    meant = vectors.join(v.select("query_id", "variant_id"), ["query_id", "variant_id"], "left_semi").select(pair, "q") if vectors is not None else None
    hits = merged_search(store, asked, meant, org, cfg.search_top_k, excluded=["faq"] if apart else None)
    hits = keep(hits.select("query_id.query_id", "query_id.variant_id", "chunk_id", "rank"), "hits")
    seeds = keep(fuse_variants(hits, cfg, "chunk_id"), "seeds")
    if scorer is None:
        kept = _fused_order(seeds, cfg)
    else:
        every = store.chunks.select("chunk_id", "text")
        every = every.unionByName(store.uploads.chunks.select("chunk_id", "text")) if store.uploads else every
        texts = every.select("chunk_id", F.substring("text", 1, cfg.rerank_chars).alias("_chunk"))
        pairs = texts.join(small(seeds.select("query_id", "chunk_id"), seeds.count()), "chunk_id").join(v, "query_id")  # cfg.seeds a query
        keyed = pairs.select("query_id", "variant_id", "chunk_id", "text", F.col("_chunk").alias("passage"))
        if isinstance(scorer, PairModel):
            matrix = keep(score_pairs(keyed, scorer), "matrix")
            failed = matrix.where("failed").select("query_id").distinct()
            matrix = matrix.join(failed, "query_id", "left_anti").drop("failed")
        else:
            failed, matrix = None, keep(keyed.select("query_id", "variant_id", "chunk_id", scorer(F.col("text"), F.col("passage")).alias("score")), "matrix")
        kept = slots(matrix, passing(rerank(matrix, "chunk_id", cfg.rank_by), cfg.threshold, "chunk_id"), "chunk_id", cfg)
        kept = kept.unionByName(_fused_order(seeds.join(failed, "query_id", "left_semi"), cfg)) if failed is not None else kept
    kept = keep(kept, "kept")
    near = store.neighbours.join(small(kept.select(F.col("chunk_id").alias("seed")).distinct(), kept.count()), "seed", "left_semi")  # cfg.seeds a query
    near = near.join(visible(store.chunks, org).select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    out = carry_neighbours(kept, near, "chunk_id", cfg)
    if apart and cfg.faq_k > 0:
        first = asked.where("query_id.variant_id = 0").select("query_id.query_id", "text")
        q0 = vectors.where("variant_id = 0").select("query_id", "q") if vectors is not None else None
        out = append_faq(out, store_search(store, first, q0, org, cfg.faq_k, kinds=["faq"]), "chunk_id", cfg)
    counts = out.groupBy("query_id").agg(F.count_if(F.col("origin") == "search").alias("kept"), F.count_if(F.col("origin") == "graph").alias("carried"), F.count_if(F.col("origin") == "faq").alias("faq"))
    recalled = hits.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("recalled")).join(seeds.groupBy("query_id").agg(F.count("*").alias("seeds")), "query_id")
    stats = v.groupBy("query_id").agg(F.count("*").alias("queries")).join(recalled, "query_id", "left").join(counts, "query_id", "left").na.fill(0)
    return out, stats
