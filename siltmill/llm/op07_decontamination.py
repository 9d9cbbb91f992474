"""Benchmark decontamination: size-partitioned MinHash containment search with Spark expressions only.

An item of m distinct shingles that a document contains to at least t misses at most m - ceil(t m) of them, so any
m - ceil(t m) + 1 of its shingles include one that the document has. The item's sketch is that many of its smallest
shingle hashes: the search loses no pair. Items are partitioned by size (powers of two); for each partition the largest
sketched hash bounds what a document has to look up, and a document looks up only partitions whose items it is long
enough to contain. Candidates are then verified on whole shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, digest, discard, small, stored

def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles(w: Column, n: int) -> Column:
    """Space-joined runs of n words, repeats included; fewer words are one run, none are none."""
    long = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(F.size(w) >= n, long).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def _hashes(w: Column, n: int) -> Column:
    """A hash for each shingle, made from the words' hashes; w: array of the words' hashes."""
    long = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
    return F.when(F.size(w) >= n, long).when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)))).otherwise(F.array().cast("array<bigint>"))


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """digest (of a document's text), item_id, n_shared, n_shingles, containment of pairs at or above the threshold.

    One row for each different text and item row. Items without a word match nothing; items of fewer than n words match
    texts that are just those words. Null texts contain nothing. Case, punctuation and spacing don't count. Repeated
    item rows are one. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    # Words are columns of their own: inside a lambda the whole expression would be computed for each shingle.
    it = items.select("item_id", words(F.col("text")).alias("w")).withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    it = it.select("item_id", F.array_distinct(shingles(F.col("w"), n)).alias("item_shingles"), F.array_sort(F.array_distinct(_hashes(F.col("hw"), n))).alias("h"))
    it = it.where(F.size("item_shingles") > 0).dropDuplicates(["item_id", "item_shingles"]).withColumn("m", F.size("item_shingles"))
    least = F.ceil(F.lit(threshold) * F.col("m") - 1e-9)
    sketch = it.select("item_id", F.floor(F.log2("m")).cast("int").alias("part"), F.explode(F.slice("h", 1, (F.col("m") - least + 1).cast("int"))).alias("hash"))
    bounds = sketch.groupBy("part").agg(F.max("hash").alias("top"), F.count("*").alias("rows")).collect()  # at most 31 rows
    few = sum(b["rows"] for b in bounds) <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda x: x)

    d = docs.select(digest().alias("digest"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    d = d.select("digest", _hashes(F.col("w"), n).alias("h"))
    low = F.lit(-(1 << 63))
    top = reduce(lambda acc, b: F.greatest(acc, F.when(F.size("h") >= threshold * 2 ** b["part"], F.lit(b["top"])).otherwise(low)), bounds, low)
    probes = d.withColumn("top", top).select("digest", F.explode(F.filter("h", lambda x: x <= F.col("top"))).alias("hash"))
    pairs = stored(probes.join(hint(sketch.select("item_id", "hash")), "hash").select("digest", "item_id").distinct(), "leak-candidates")
    rows = pairs.count()

    # Candidates are few: their digests go to the texts, one text for each digest comes back, and its shingles are made once.
    wanted = small(pairs.select("digest").distinct(), rows)
    texts = docs.select(digest().alias("digest"), F.col("text").alias("_text")).join(wanted, "digest", "left_semi")
    once = texts.groupBy("digest").agg(F.first("_text").alias("_text")).withColumn("w", words(F.col("_text"))).select("digest", shingles(F.col("w"), n).alias("doc_shingles"))
    both = once.join(small(pairs, rows), "digest").join(hint(it.select("item_id", "item_shingles", "m")), "item_id")
    shared = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    found = both.select("digest", "item_id", shared.alias("n_shared"), F.col("m").alias("n_shingles"))
    found = found.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)).distinct()
    found = stored(found.withColumn("containment", F.col("n_shared") / F.col("n_shingles")), "leaks")
    discard(pairs)
    return found


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: one row for each row of docs and item it contains."""
    found = contained_items(docs, items, n, threshold)
    return docs.select("doc_id", digest().alias("digest")).join(small(found, found.count()), "digest").drop("digest")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of docs, all columns, that contain no item."""
    found = contained_items(docs, items, n, threshold)
    bad = small(found.select(F.col("digest").alias("_siltmill_bad")).distinct(), found.count())
    return docs.join(bad, digest() == bad["_siltmill_bad"], "left_anti")
