"""Parsers over the driver's tables; SQL cannot express them, so the fixtures in tests/ are their proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..sources.markdown import parse_documents
from ..streaming.events import windowed_counts
from .tables import query, table


@query()
def parse_blocks(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), "text")
    return parse_documents(files)


@query()
def html_blocks(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return parse_documents(files)


@query()
def typed_chunks(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.concat_ws(" ", "lang", "source").alias("title"), "text")
    return chunk_documents(files)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, count(*) filter (where event_type = 'error') as n_errors from events group by all")
def event_windows(spark, sf):
    """The streaming operator's plan over the whole log as one batch."""
    out = windowed_counts(table(spark, sf, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
