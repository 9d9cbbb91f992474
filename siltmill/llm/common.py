"""What the operators of this subpackage share: rows, digests, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches  # noqa: F401


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of its store; without one it is Spark's default store, for Python workers too."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder (URI) below the shared one that the session names in spark.checkpoint.dir.

    Where the setting is empty, on a local master (tests, one machine) a temporary folder of this machine becomes the
    checkpoint folder; on any other master that is an error, since executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="siltmill-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return qualified(spark, f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, lost executors don't matter."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltmill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing reads any more. Those that a result still reads stay in the shared folder."""
    for t in tables:
        spark = t.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._siltmill_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def each_text(texts: pa.Array, size: int = 256) -> Iterator[str | None]:
    """The texts of an Arrow batch, of which few are Python strings at once."""
    for at in range(0, len(texts), size):
        yield from texts.slice(at, size).to_pylist()


#: Rows of ids, digests and other short keys up to which a table is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if its rows, which were counted, are at most BROADCAST_ROWS; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def digest(col: str = "text") -> Column:
    """16-byte content key; null and the empty text differ."""
    return F.when(F.col(col).isNull(), F.lit(b"null")).otherwise(F.unhex(F.md5(F.col(col))))


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder in the shared store, named with its scheme: file:, hdfs:, s3:, gs:."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no store")
    return fs.FileSystem.from_uri(uri)
