"""What is kept between searches: index segments of uploads, and an index of vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blockmax, tenants
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..operators.segments import TenantSegments
from ..sources.snapshots import Catalog
from .search_queries import _VQ, _VS, PASS, _vector_queries, doc_index
from .tables import DOCS, bm25_sql, docs, passages, query, scratch, stored, table, top_sql

TENANTS = ("SRC7", "SRC9")


def _uploaded(spark, sf):
    """The segments of two tenants: each uploads its documents in two parts, replaces some and deletes some."""
    seg = TenantSegments(Catalog(spark, scratch(spark, "uploads")))
    all_ = docs(spark, sf).withColumn("chunk_id", F.concat("org_id", F.lit("#"), F.col("doc_id").cast("string"))).select("doc_id", "chunk_id", "org_id", F.col("text").alias("embed_text"))
    for org in TENANTS:
        own = all_.where(F.col("org_id") == org)
        seg.upload(org, own.where("doc_id % 2 = 0 or doc_id % 3 = 0"))
        revised = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("revised "), F.coalesce("embed_text", F.lit("")))).otherwise(F.col("embed_text"))
        seg.upload(org, own.where("doc_id % 2 = 1 or doc_id % 6 = 0").withColumn("embed_text", revised))
        seg.delete(org, own.where("doc_id % 10 = 4").select("doc_id"))
    return seg


_LIVE = "live as (select org_id, doc_id, case when doc_id % 6 = 0 then 'revised ' || coalesce(text, '') else text end as text from docs where doc_id % 10 <> 4)"
_EACH = ", ".join(f"c_{o} as (select doc_id, text from live where org_id = '{o}'), {bm25_sql(f'c_{o}', 'passages', name=f'x_{o}')}, {top_sql(f'x_{o}', f't_{o}', 'doc_id', 10)}" for o in TENANTS)
_BOTH = " union all ".join(f"select '{o}' as org_id, query_id, '{o}#' || doc_id as chunk_id, score, rank from t_{o}" for o in TENANTS)


@query(f"with {DOCS}, {PASS}, {_LIVE}, {_EACH.replace('score desc, doc_id', 'score desc, cast(doc_id as varchar)')} {_BOTH}")
def tenant_upload_search(spark, sf):
    """Each tenant finds what its uploads, replacements and deletions have left, and nothing of the other one."""
    seg = _uploaded(spark, sf)
    out = None
    for org in TENANTS:
        top = R.top_k(R.bm25(seg.index(org), passages(spark, sf)), ["query_id"], "score", ["chunk_id"], 10).withColumn("org_id", F.lit(org))
        out = top if out is None else out.unionByName(top)
    return out


@query(
    f"with {DOCS}, {_LIVE} select org_id, count(*) as n_docs, cast(sum(length(text)) as bigint) as n_chars, 1 as n_segments from live where org_id in {TENANTS} group by org_id"
)
def tenant_segments_merged(spark, sf):
    """Merging keeps what is live, as one segment for each tenant."""
    seg = _uploaded(spark, sf)
    out = None
    for org in TENANTS:
        seg.merge(org)
        row = seg.chunks(org).agg(F.lit(org).alias("org_id"), F.count("*").alias("n_docs"), F.sum(F.length("embed_text")).alias("n_chars"), F.count_distinct("segment").cast("int").alias("n_segments"))
        out = row if out is None else out.unionByName(row)
    return out


def vector_index(spark, sf):
    folder = scratch(spark, "vector-index")
    V.build(table(spark, sf, "embeddings"), folder)
    return V.open_index(spark, folder)


@query(f"with {_VQ}, {_VS}, {top_sql('vs', 'top', 'vec_id', 10)} select * from top")
def vector_index_exact(spark, sf):
    """The ten nearest vectors through the index, with every cell that could hold a nearer one."""
    return V.search(vector_index(spark, sf), _vector_queries(spark, sf), 10, exact=True)


@query("select (select count(*) from embeddings) as n_indexed, (select count(*) from embeddings where vec_id % 50 = 0) as n_queries, true as recall_reached")
def vector_index_recall(spark, sf):
    """Vectors indexed, queries asked, and whether the probed cells gave 0.9 or more of the true ten nearest."""
    index, asked = vector_index(spark, sf), _vector_queries(spark, sf)
    got = stored(V.search(index, asked, 10), "vector-hits")
    true = R.dense_top(table(spark, sf, "embeddings"), asked, "vec_id", 10)
    both = true.join(got.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    sums = both.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("_hit") >= 0.9 * F.count("*")).alias("recall_reached"))
    return index.rows().agg(F.count("*").alias("n_indexed")).crossJoin(F.broadcast(sums))  # one row each


def vector_index_topk(spark, sf):
    """The hits of the probed cells alone (approximate, so without SQL; vector_index_recall measures them)."""
    return V.search(vector_index(spark, sf), _vector_queries(spark, sf), 10)


query()(vector_index_topk)


@query(f"with {PASS}, {bm25_sql('documents', 'passages')}, {top_sql('scores', 'top', 'doc_id', 10)} select * from top where score > 0")
def blockmax_topk(spark, sf):
    """The ten best documents by BM25, without the blocks of documents whose bounds lie below the tenth."""
    blocks = blockmax.block_index(doc_index(spark, sf), keep=stored)
    return blockmax.block_top(blocks, passages(spark, sf), 10, keep=stored)[0].where("score > 0")


def _asks(spark, sf):
    """tenant, query_id: four tenants of the data ask each passage, dealt by their places in the list of tenants."""
    place = F.row_number().over(Window.orderBy("tenant")) - 1  # a row for each tenant
    listed = docs(spark, sf).where("org_id <> 'PUBLIC'").select(F.col("org_id").alias("tenant")).distinct()
    listed = listed.select("tenant", place.alias("place")).join(F.broadcast(listed.agg(F.count("*").alias("n"))))
    slots = passages(spark, sf).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    wanted = slots.crossJoin(F.broadcast(listed.select("n").distinct())).select("query_id", ((F.col("query_id") * 4 + F.col("i")) % F.col("n")).alias("place"))  # n is one row
    return wanted.join(listed.select("tenant", "place"), "place").select("tenant", "query_id")


def _tenant_hits(spark, sf):
    best = R.bm25_top(doc_index(spark, sf), passages(spark, sf), 10, seen=lambda d: d.where("org_id is not null"), by="org_id")
    return tenants.of_owners(best, _asks(spark, sf), "doc_id", 10)


_HITS = f"""{DOCS}, {PASS}, {bm25_sql('documents', 'passages')}, who as (select org_id as tenant, row_number() over (order by org_id) - 1 as place, count(*) over () as n from (select distinct org_id from docs where org_id <> 'PUBLIC')),
asks as (select distinct tenant, query_id from (select query_id, unnest([0, 1, 2, 3]) as i from passages) join who on place = (query_id * 4 + i) % n),
hits as (select * from (select tenant, query_id, doc_id, score, row_number() over (partition by tenant, query_id order by score desc, doc_id) as rank from scores join docs using (doc_id) join asks using (query_id) where org_id in ('PUBLIC', tenant)) where rank <= 10)"""


@query(f"with {_HITS} select * from hits")
def tenant_pair_search(spark, sf):
    """Every tenant's own search results in one plan: pairs of question and tenant, visibility as a join."""
    return _tenant_hits(spark, sf)


@query(f"with {_HITS} select tenant, count(*) as hits, count(*) filter (where org_id not in ('PUBLIC', tenant)) as leaked from hits join docs using (doc_id) group by tenant")
def tenant_leak_audit(spark, sf):
    """What every tenant of the data was shown by its searches, and how much of it belongs to others."""
    return tenants.leaks(_tenant_hits(spark, sf), docs(spark, sf).select("doc_id", "org_id"), "doc_id")
