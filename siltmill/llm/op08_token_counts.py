"""Token counts with a digest cache.

A content is known by (digest of its normalised text, digest of the tokenizer's version). Contents that the cache does
not hold are encoded once each, however many documents repeat them, and appended; every count then comes from the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, small, stored, text_or_empty
from .tokens import coder, default_tokenizer, tokenizer_version

CACHE = "digest binary, n_bytes long, n_tokens long, version string"


def _count(path: str, version: str):
    if path.endswith(".model"):

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            for b in batches:
                texts = [x.as_py() for x in b.column(1)]
                yield _rows(b, version, [len(t.encode()) for t in texts], [len(x) for x in model.encode(texts, num_threads=1)])
    else:

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = coder(path)
            for b in batches:
                yield _rows(b, version, [len(x.as_buffer() or b"") for x in b.column(1)], [len(c.encode(x.as_py())) // 4 for x in b.column(1)])

    return encode


def _rows(batch, version, sizes, counts):
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([version] * len(counts), pa.string())], ["digest", "n_bytes", "n_tokens", "version"])


def read_cache(spark: SparkSession, cache: str, version: str | None = None) -> DataFrame:
    """The cache's rows, of one version only if it is given (a folder of its own, so that no other is read); a folder that
    does not exist yet is an empty cache."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    held = spark.read.schema(CACHE).parquet(cache)
    return held if version is None else held.where(F.col("version") == version)


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text; null counts as empty.

    cache: folder of the cache, kept between calls; by default a new one below the shared folder. The normalised
    content is the text itself with null as empty, because any other change could change a count. Rows are one for each
    input row: repeated rows and null ids stay, other columns are ignored. An empty table gives no rows. Two runs that
    append the same content leave equal rows, which are read as one.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    version = tokenizer_version(path)
    cache = cache or shared_dir(spark, "token-cache")
    text = text_or_empty()
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("_digest"), text.alias("_text"))
    different = keyed.select(F.col("_digest").alias("digest")).distinct()
    misses = stored(different.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti"), "token-misses")
    few = small(misses, misses.count())
    texts = keyed.join(few, keyed._digest == few.digest, "left_semi").groupBy("_digest").agg(F.first("_text").alias("_text"))
    texts.mapInArrow(_count(path, version), CACHE).write.mode("append").partitionBy("version").parquet(cache)
    counts = read_cache(spark, cache, version).join(different, "digest", "left_semi")
    counts = stored(counts.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens")), "token-counts")
    discard(misses)
    out = keyed.select("doc_id", "_digest").join(counts, F.col("_digest") == F.col("digest"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
