"""SimHash near-duplicates by vantage-point trees.

Different fingerprints are partitioned by vantage-point trees that are fitted on bounded samples: an inner node sends a
fingerprint to its near side or far side by the Hamming distance to the node's vantage point. A fingerprint lives in one
leaf and, by the triangle bound, also visits every leaf that can hold a fingerprint within the radius. Leaves that are
too large grow a tree of their own until none is. Each leaf is searched with a vantage-point tree, too. Leaves return a spanning forest of their links, and components come from
alternating large-star and small-star rounds over those forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, discard, small, stored

BLOCK = 2_000_000  # distances computed at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the words' shingles, hashed by XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        to = min(n, at + 65_536)
        pairs = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in pairs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, column: str = "fp") -> DataFrame:
    """docs with the fingerprint as a (signed) long in `column`; null and wordless texts have 0."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(column, fp("text"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _split(fps: np.ndarray, radius: int, rng) -> tuple[np.uint64, int] | None:
    """Vantage point and bound that cost the fewest visits for what they divide: the share of fingerprints at the
    boundary, by the bits of information in the sides' sizes. A side has a fifth or more where that is possible."""
    best, n = None, len(fps)
    for vp in rng.choice(fps, min(24, n), replace=False):
        hist = np.bincount(np.bitwise_count(fps ^ vp), minlength=65)
        near = np.cumsum(hist)
        for mu in np.flatnonzero((near[:64] > 0) & (near[:64] < n)).tolist():
            p = near[mu] / n
            edge = hist[max(0, mu - radius + 1) : mu + radius + 1].sum() / n
            rank = (min(p, 1 - p) < 0.2, math.log1p(edge) / -(p * math.log2(p) + (1 - p) * math.log2(1 - p)))
            if best is None or rank < best[0]:
                best = (rank, vp, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, depth: int, radius: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, bound, near child, far child); a child below 0 is leaf -1 - child. Node 0 is the root;
    no nodes: there is only leaf 0."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def grow(fps: np.ndarray, left: int) -> int:
        nonlocal leaves
        found = _split(fps, radius, rng) if left > 0 and len(fps) >= 8 else None
        if found is None:
            leaves += 1
            return -leaves
        vp, mu = found
        me = len(nodes)
        nodes.append(None)
        near = np.bitwise_count(fps ^ vp) <= mu
        nodes[me] = (int(vp), int(mu), grow(fps[near], left - 1), grow(fps[~near], left - 1))
        return me

    grow(sample, depth)
    return nodes


def route(fps: np.ndarray, nodes, radius: int, lives: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index into fps, whether the fingerprint lives there) of each place that a fingerprint lives in or visits.

    Of two leaves, visitors go from the one of larger number to the smaller, so that a pair meets once. Fingerprints that
    do not live in the tree's space (lives is false) visit every leaf within reach.
    """
    lives = np.ones(len(fps), bool) if lives is None else lives
    out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def down(node: int, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if node < 0:
            out.append((-1 - node, idx, home))
            return
        vp, mu, near, far = nodes[node]
        d = np.bitwise_count(fps[idx] ^ np.uint64(vp)).astype(np.int64)
        for child, stays, visits in ((near, d <= mu, d - radius <= mu), (far, d > mu, d + radius > mu)):
            down(child, idx[visits], (home & stays)[visits])

    down(0 if nodes else -1, np.arange(len(fps)), lives)
    leaf = np.concatenate([np.full(len(i), n) for n, i, _ in out]) if out else np.zeros(0, np.int64)
    idx = np.concatenate([i for _, i, _ in out]) if out else np.zeros(0, np.int64)
    home = np.concatenate([h for _, _, h in out]) if out else np.zeros(0, bool)
    lives_in = np.zeros(len(fps), np.int64)
    lives_in[idx[home]] = leaf[home]
    keep = home | ~lives[idx] | (leaf < lives_in[idx])
    return leaf[keep], idx[keep], home[keep]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label[i] leads to the smallest member."""
    while len(a):
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        ra, rb = label[a], label[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def near_pairs(homes: np.ndarray, guests: np.ndarray, radius: int, rng) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into homes, into homes followed by guests) within the radius, by a vantage-point tree over homes."""
    everyone = np.concatenate([homes, guests])

    def search(h: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(h) or not len(q):
            return
        found = _split(homes[h] if len(h) <= 4096 else rng.choice(homes[h], 4096, replace=False), radius, rng) if len(h) > 256 else None
        if found is None:
            for at in range(0, len(h), step := max(1, BLOCK // len(q))):
                i, j = np.nonzero(distances(homes[h[at : at + step]], everyone[q]) <= radius)
                yield h[at : at + step][i], q[j]
            return
        vp, mu = found
        near = np.bitwise_count(homes[h] ^ vp) <= mu
        d = np.bitwise_count(everyone[q] ^ vp).astype(np.int64)
        yield from search(h[near], q[d - radius <= mu])
        yield from search(h[~near], q[d + radius > mu])

    yield from search(np.arange(len(homes)), np.arange(len(everyone)))


def _leaf_forest(radius: int):
    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        home = pdf["home"].to_numpy(bool)
        order = np.argsort(fps, kind="stable")  # labels then lead to the smallest fingerprint
        fps, home = fps[order], home[order]
        own, other = np.flatnonzero(home), np.flatnonzero(~home)
        back = np.concatenate([own, other])
        label = np.arange(len(fps))
        bits = fps.view(np.uint64)
        for a, b in near_pairs(bits[own], bits[other], radius, np.random.default_rng(3)):
            unite(label, back[a], back[b])
        while (label[label] != label).any():
            label = label[label]
        child = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"u": fps[child], "v": fps[label[child]]})

    return forest


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the nodes that edges (u, v with u > v) touch, roots left out.

    Each round keeps components and lowers their labels, and the one that changes nothing is the last.
    """
    edges = stored(edges.distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, old = stored(small, "links"), edges
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


#: Children of a leaf that is split once more; how often that is done; the bytes of trees that tasks hold at once.
FAN_OUT, LEVELS, TREE_BYTES = 256, 6, 32 << 20


def _fit(radius: int, leaf_size: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = min(8, math.ceil(math.log2(pdf["n"].iloc[0] / leaf_size)))
        nodes = build_tree(pdf["fp"].to_numpy(np.int64).view(np.uint64), depth, radius)
        table = np.array([(v, m, a, b) for v, m, a, b in nodes], dtype=[("v", "<u8"), ("m", "<i8"), ("a", "<i8"), ("b", "<i8")])
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "tree": [table.tobytes()]})

    return fit


def _deal(trees: dict[int, bytes], radius: int):
    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = {leaf: [tuple(map(int, n)) for n in np.frombuffer(t, dtype=[("v", "<u8"), ("m", "<i8"), ("a", "<i8"), ("b", "<i8")])] for leaf, t in trees.items()}
        for pdf in parts:
            for leaf, own in pdf.groupby("leaf", sort=False):
                if leaf not in grown:  # no fingerprint of the sample: one child, which does not shrink and goes by blocks
                    yield own.assign(leaf=own["leaf"] * FAN_OUT)
                    continue
                fps = own["fp"].to_numpy(np.int64)
                child, idx, home = route(fps.view(np.uint64), grown[leaf], radius, own["home"].to_numpy(bool))
                yield pd.DataFrame({"leaf": leaf * FAN_OUT + child, "fp": fps[idx], "home": home})

    return deal


def _sampled(rows: DataFrame, leaves: DataFrame, sample: int) -> DataFrame:
    """leaf, n, fp: about `sample` of the fingerprints at home in each leaf (leaf, n, homes), those whose hash lies below
    the leaf's share. Each task picks its own, so a leaf that holds every fingerprint is neither sent nor sorted."""
    share = F.when(F.col("homes") <= sample, 1.0).otherwise(sample / F.col("homes"))
    lot = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.lit(1 << 31)) / float(1 << 31)
    return rows.where("home").join(small(leaves, leaves.count()), "leaf").where(lot < share).select("leaf", "n", "fp")


def link_fingerprints(fps: DataFrame, radius: int = 2, leaf_size: int = 16_384, sample: int = 4096) -> DataFrame:
    """node, root for each of the different fingerprints (column fp) that links to a smaller one, directly or not.

    A leaf with more than twice leaf_size rows (those that live there and visitors) is split once more, by a tree that a task
    fits on about `sample` of the leaf's fingerprints (by a hash), until leaves are small. Trees come to the driver in
    waves of TREE_BYTES. A leaf that splitting does not make smaller, or that LEVELS
    splits leave too large, is searched in pairs of blocks. All rows are routed.
    """
    place = "leaf long, fp long, home boolean"
    rows = stored(fps.select(F.lit(1).cast("long").alias("leaf"), "fp", F.lit(True).alias("home")), "vantage-rows")
    before = None
    forests = []
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        parent = F.floor(F.col("leaf") / FAN_OUT).cast("long")
        if before is not None:
            old = before.select(F.col("leaf").alias("_p"), F.col("n").alias("_n"))
            sizes = sizes.join(old, parent == F.col("_p"), "left").drop("_p")
        else:
            sizes = sizes.withColumn("_n", F.lit(None).cast("long"))
        sizes = stored(sizes.withColumn("stuck", F.coalesce(F.col("n") > 0.9 * F.col("_n"), F.lit(False)) | F.lit(level == LEVELS)), "leaf-sizes")
        large = sizes.where(F.col("n") > 2 * leaf_size).select("leaf", "n", "homes", "stuck")
        forests.append(stored(rows.join(large.select("leaf"), "leaf", "left_anti").groupBy("leaf").applyInPandas(_leaf_forest(radius), "u long, v long"), "leaf-links"))
        forests.append(stored(_by_blocks(rows.join(large.where("stuck").drop("homes"), "leaf"), radius, leaf_size), "block-links"))
        again = large.where("not stuck").select("leaf", "n", "homes")
        if again.isEmpty():
            break
        taken = _sampled(rows, again, sample)
        trees = stored(taken.groupBy("leaf").applyInPandas(_fit(radius, leaf_size), "leaf long, tree binary"), "vantage-trees")
        waves = max(1, math.ceil((trees.agg(F.sum(F.octet_length("tree") + 100)).first()[0] or 0) / TREE_BYTES))
        split = None
        for w in range(waves):
            mine = F.pmod(F.xxhash64("leaf"), F.lit(waves)) == w
            held = {r["leaf"]: bytes(r["tree"]) for r in trees.where(mine).collect()}
            some = rows.where(mine).join(again.select("leaf"), "leaf", "left_semi").mapInPandas(_deal(held, radius), place)
            split = some if split is None else split.unionByName(some)
        rows, done = stored(split, "vantage-rows"), [rows, trees, *([before] if before is not None else [])]
        discard(*done)
        before = sizes
    links = forests[0]
    for f in forests[1:]:
        links = links.unionByName(f)
    found = components(links)
    discard(rows, *forests)
    return found


def _by_blocks(rows: DataFrame, radius: int, leaf_size: int) -> DataFrame:
    """Links of leaves (leaf, n, fp, home) too large for a task: blocks of about leaf_size rows meet pair by pair."""
    blocks = F.ceil(F.col("n") / leaf_size)
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("_blocks")))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    pair = met.select("leaf", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "fp", "home")
    return pair.groupBy("leaf", "i", "j").applyInPandas(_leaf_forest(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, leaf_size: int = 16_384) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id that is reachable over links).

    One row for each input row. Null and wordless texts have fingerprint zero and link like any other. Null ids are
    skipped in the smallest; a component of null ids only has null. Repeated rows stay, other columns are ignored, an
    empty table gives no rows. Copies meet in their common fingerprint and are never expanded into pairs.
    """
    rows = stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    table = with_components(rows, radius, leaf_size)
    return rows.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_components(rows: DataFrame, radius: int, leaf_size: int = 16_384, key: str = "doc_id") -> DataFrame:
    """fp, component_id (the smallest `key` of the component) for each different fp of rows (fp, key)."""
    first = stored(rows.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-table")
    links = link_fingerprints(first.select("fp"), radius, leaf_size)
    rooted = first.join(links, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of docs, all columns, for each component: the one with the smallest doc_id (null last), then content digest.

    A text that rows repeat keeps one row (they are thinned out before the shuffle, too), and wordless texts, null among
    them, keep one in all. An empty table stays empty.
    """
    name, rank = "_siltmill_digest", "_siltmill_rank"
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest().alias("digest"))
    rows = stored(fingerprints(docs.select("text", key.alias("key")), shingle).select("fp", "key"), "fingerprints")
    best = with_components(rows, radius, key="key").select(F.col("component_id.digest").alias(name)).distinct()
    first = F.row_number().over(Window.partitionBy(name).orderBy(F.col("doc_id").asc_nulls_last()))
    one = docs.withColumn(name, digest()).withColumn(rank, first).where(F.col(rank) == 1)
    return one.join(best, name, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
