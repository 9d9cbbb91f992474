"""Session defaults and the tenant variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLIC = "PUBLIC"

#: Settings that suit a cluster; the caller's own win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(name: str = "siltmill", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows of an Arrow batch of whole texts. Spark's 10,000 texts are held several times at once: as rows that wait for a Python
#: worker, in Arrow on both sides, and in what the worker makes of them.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Sessions that don't set the rows of an Arrow batch get BATCH_ROWS; the caller's own setting wins."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def visible(df: DataFrame, org: str | None, column: str = "org_id") -> DataFrame:
    """Rows that a tenant may read: public ones and its own. Without a tenant only public rows (fail closed)."""
    return df.where(F.col(column).isin(PUBLIC, org) if org else F.col(column) == PUBLIC)


def own_only(df: DataFrame, org: str | None, column: str = "org_id") -> DataFrame:
    """Private uploads: the tenant's own rows, never public ones; no tenant, no rows."""
    return df.where(F.col(column) == org) if org and org != PUBLIC else df.where(F.lit(False))


def check_writable(df: DataFrame, org: str, column: str = "org_id") -> DataFrame:
    """df, in which a row of another tenant (or of none) makes the job fail when it is written."""
    if not org:
        raise PermissionError("a write needs a tenant")
    ok = F.coalesce(F.col(column) == org, F.lit(False))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit("row of another tenant"))))


def tenant_view(spark: SparkSession, table: str, view: str, variable: str = "app_org") -> None:
    """A view of a registered table that follows the session variable, and shows public rows while it is empty."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} STRING DEFAULT ''")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT * FROM {table} WHERE org_id IN ('{PUBLIC}', {variable})")
