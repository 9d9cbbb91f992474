"""Searches of many tenants in one plan: who asks is a column, and what they may see is a join.

A question's scores do not depend on who asks. For each question the best k of each owner's documents are kept once; a
tenant's list is made of the public best and of its own best, so nothing that another tenant owns is ever joined to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import PUBLIC
from .retrieval import top_k


def search_pairs(scores: DataFrame, owners: DataFrame, asks: DataFrame, key: str, k: int) -> DataFrame:
    """tenant, query_id, key, score, rank: the k best of scores (query_id, key, score) for each of asks (tenant, query_id), of
    what owners (key, org_id) lets the tenant see: public rows and its own. Filters hold before ranking. A null or empty
    tenant sees public rows only; rows without an owner are seen by none."""
    owned = scores.join(owners.select(key, "org_id").where("org_id is not null"), key)
    return of_owners(top_k(owned, ["query_id", "org_id"], "score", [key], k), asks, key, k)


def of_owners(best: DataFrame, asks: DataFrame, key: str, k: int) -> DataFrame:
    """search_pairs from each owner's own best k (query_id, org_id, key, score) for each question."""
    pairs = asks.select("tenant", "query_id").distinct()
    public = pairs.join(best.where(F.col("org_id") == PUBLIC), "query_id")
    own = pairs.join(best.where(F.col("org_id") != PUBLIC).withColumnRenamed("org_id", "tenant"), ["tenant", "query_id"])
    both = public.select("tenant", "query_id", key, "score").unionByName(own.select("tenant", "query_id", key, "score"))
    return top_k(both, ["tenant", "query_id"], "score", [key], k)


def leaks(hits: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """tenant, hits, leaked: what each tenant was shown (tenant, key), and how much of it belongs to another tenant or to
    nobody known. It looks at results, whatever made them."""
    seen = hits.select("tenant", key).join(owners.select(key, "org_id"), key, "left")
    fair = (F.col("org_id") == PUBLIC) | F.col("org_id").eqNullSafe(F.nullif(F.col("tenant"), F.lit(""))) & F.col("org_id").isNotNull()
    return seen.groupBy("tenant").agg(F.count("*").alias("hits"), F.count_if(~F.coalesce(fair, F.lit(False))).alias("leaked"))
