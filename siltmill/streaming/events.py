"""Structured Streaming over the audit log and incoming documents (beyond the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.writes import replace_parts
from ..sources.snapshots import Catalog


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and errors by window and type; rows later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select("window.start", "event_type", "n", "n_errors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def replace_batches(catalog: Catalog, table: str, key: str):
    """A foreachBatch function: each batch replaces the documents that it brings and publishes a snapshot."""

    def write(batch: DataFrame, epoch: int) -> None:
        now = catalog.current().get("tables", {})
        new = replace_parts(catalog.read(table), batch, [key]) if table in now else batch
        catalog.publish({table: new}, {"epoch": epoch})

    return write
