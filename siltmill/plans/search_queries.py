"""Lexical, dense, hybrid search, rank assembly and the flagship end-to-end retrieval."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import corpus as C
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import rounds
from ..session import visible
from .tables import COSINE, DENSE, DOCS, FAQ, LINES, QVEC, VARIANTS, bm25_sql, docs, faq, lexical_index, passages, query, query_vectors, rrf_sql, stored, table, tok, top_sql, variants

PASS = "passages as (select item_id as query_id, text from benchmark)"


def doc_index(spark, sf):
    """The documents' index, with what searches filter by."""
    d = table(spark, sf, "documents")
    d = docs(spark, sf) if "source" in d.columns else d
    return lexical_index(d.select("doc_id", "text", *(c for c in ("org_id", "lang") if c in d.columns)), "documents", "doc_id")


def _lexical(spark, sf, variant="sparse"):
    return R.bm25(doc_index(spark, sf), passages(spark, sf), variant)


def _lexical_top(spark, sf, k, variant="sparse", seen=None):
    return R.bm25_top(doc_index(spark, sf), passages(spark, sf), k, variant, seen=seen)


def _vectors(spark, sf, within=None):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v if within is None else v.join(within, "doc_id", "left_semi")


def _fused(spark, sf, top, seen=None):
    """Hybrid search of the passages: both legs cut at max(3 top, 30), filtered before they are ranked."""
    depth = max(3 * top, 30)
    within = seen(docs(spark, sf)).select("doc_id") if seen else None
    lex = _lexical_top(spark, sf, depth, seen=seen)
    sem = R.dense_top(_vectors(spark, sf, within), query_vectors(spark, sf), "doc_id", depth)
    return R.top_k(R.rrf([lex, sem], "doc_id"), ["query_id"], "score", ["doc_id"], top)


@query(f"with {PASS}, {bm25_sql('documents', 'passages')} select * from scores")
def bm25_scores(spark, sf):
    return _lexical(spark, sf)


@query(f"with {PASS}, {bm25_sql('documents', 'passages')}, {top_sql('scores', 'top', 'doc_id', 10)} select * from top where score > 0")
def bm25_topk(spark, sf):
    return _lexical_top(spark, sf, 10).where("score > 0")


@query(f"with {PASS}, {bm25_sql('documents', 'passages', variant='okapi')}, {top_sql('scores', 'top', 'doc_id', 10)} select * from top")
def bm25_okapi(spark, sf):
    return _lexical_top(spark, sf, 10, "okapi")


@query(f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({tok('text')}) as term from documents) group by all) group by 1")
def df_table(spark, sf):
    p = doc_index(spark, sf).postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    f"""with a as (select doc_id, len(t) as doc_len, unnest(t) as term from (select doc_id, {tok('text')} as t from documents)), p as (select doc_id, doc_len, term, count(*) as tf from a group by all),
    n as (select avg(len({tok('text')})) as avg_len from documents)
    select doc_id, ('0x' || substr(md5(term), 1, 8))::bigint % 1000000 + 1 as idx, round(sum(round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)), 5)), 5) as weight from p, n group by all"""
)
def sparse_doc_weights(spark, sf):
    """Hashed sparse vectors of the documents; terms that collide add up."""
    return R.hashed_weights(doc_index(spark, sf))


_VQ = "vq as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0)"
_VS = f"vs as (select query_id, vec_id, {COSINE.format(a='embedding', b='q')} as score from embeddings, vq)"


def _vector_queries(spark, sf):
    """The stated query set of a search: ids divisible by 50, against all vectors."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(f"with {_VQ}, {_VS}, {top_sql('vs', 'top', 'vec_id', 10)} select * from top")
def cosine_topk(spark, sf):
    q = _vector_queries(spark, sf)
    return R.dense_top(table(spark, sf, "embeddings"), q, "vec_id", 10)


@query(f"with {_VQ}, {_VS}, f as (select vs.* from vs join embeddings e using (vec_id) where e.label = 1), {top_sql('f', 'top', 'vec_id', 5)} select * from top")
def cosine_filtered_topk(spark, sf):
    q = _vector_queries(spark, sf)
    return R.dense_top(table(spark, sf, "embeddings").where("label = 1"), q, "vec_id", 5)


_HYBRID = f"{PASS}, {bm25_sql('documents', 'passages')}, {QVEC}, {DENSE}, {top_sql('scores', 'l', 'doc_id', 30)}, {top_sql('dense', 's', 'doc_id', 30)}, {rrf_sql(['l', 's'], 'fused', 'doc_id')}, {top_sql('fused', 'top', 'doc_id', 10)}"


@query(f"with {_HYBRID} select * from top")
def hybrid_rrf(spark, sf):
    return _fused(spark, sf, 10)


@query(
    f"with {DOCS}, {PASS}, seen as (select * from docs where org_id in ('PUBLIC', 'SRC7') and lang = 'en'), {bm25_sql('seen', 'passages', stats='documents')}, {QVEC}, {DENSE}, fd as (select * from dense where doc_id in (select doc_id from seen)), {top_sql('scores', 'l', 'doc_id', 30)}, {top_sql('fd', 's', 'doc_id', 30)}, {rrf_sql(['l', 's'], 'fused', 'doc_id')}, {top_sql('fused', 'top', 'doc_id', 10)} select * from top"
)
def hybrid_filtered(spark, sf):
    """Filters hold in each leg before ranking; statistics stay those of the whole collection."""
    return _fused(spark, sf, 10, lambda d: visible(d, "SRC7").where("lang = 'en'"))


@query(f"with {DOCS}, {QVEC}, {DENSE}, fd as (select * from dense where doc_id in (select doc_id from docs where org_id in ('PUBLIC', 'SRC7') and lang = 'en')), {top_sql('fd', 's', 'doc_id', 30)}, {rrf_sql(['s'], 'fused', 'doc_id')}, {top_sql('fused', 'top', 'doc_id', 10)} select * from top")
def dense_only_fallback(spark, sf):
    """What hybrid search falls back to without a lexical leg: the vector leg alone, with the same filters and fusion."""
    seen = visible(docs(spark, sf), "SRC7").where("lang = 'en'").select("doc_id")
    return R.top_k(R.rrf([R.dense_top(_vectors(spark, sf, seen), query_vectors(spark, sf), "doc_id", 30)], "doc_id"), ["query_id"], "score", ["doc_id"], 10)


def _variant_hits(spark, sf, k=40):
    """query_id, variant_id, doc_id, score, rank of every variant's lexical search."""
    v = variants(spark, sf).withColumn("vq", F.struct("query_id", "variant_id")).select(F.col("vq").alias("query_id"), "text")
    top = R.bm25_top(doc_index(spark, sf), v, k)
    return top.select("query_id.query_id", "query_id.variant_id", "doc_id", "score", "rank")


_VHITS = f"{VARIANTS}, vkey as (select query_id * 10 + variant_id as query_id, text from variants), {bm25_sql('documents', 'vkey', name='vs')}, {top_sql('vs', 'vtop', 'doc_id', 40)}, hits as (select query_id // 10 as query_id, query_id % 10 as variant_id, doc_id, score, rank from vtop)"
_SEEDS = f"{_VHITS}, fused as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 8) as score from hits group by all), {top_sql('fused', 'seeds', 'doc_id', 40)}"


@query(f"with {_SEEDS} select * from seeds")
def multi_variant_rrf(spark, sf):
    return A.fuse_variants(_variant_hits(spark, sf), A.RetrieverConfig(), "doc_id")


_FAQ_ALL = f"every as (select q.query_id, c.case_id, round(coalesce(s.score, 0), 4) as score from passages q cross join faq c left join scores s on s.query_id = q.query_id and s.case_id = c.case_id)"


@query(f"with {FAQ}, {PASS}, {bm25_sql('faq', 'passages', key='case_id', variant='okapi')}, {_FAQ_ALL}, {top_sql('every', 'top', 'case_id', 5)} select * from top")
def faq_search(spark, sf):
    """Okapi scores over the cases, 4 decimals; cases that score zero fill up the list."""
    cases = faq(spark, sf).select("case_id", "text")
    return R.filled_top(R.bm25(cases, passages(spark, sf), "okapi", key="case_id"), cases, passages(spark, sf), "case_id", 5)


_FAQ_ORG = "case when case_id // 1000 % 3 = 0 then 'PUBLIC' when case_id // 1000 % 3 = 1 then 'SRC7' else 'SRC8' end"


@query(
    f"""with {FAQ}, {PASS}, own as (select * from faq where {_FAQ_ORG} in ('PUBLIC', 'SRC7')), {bm25_sql('own', 'passages', key='case_id', stats='faq')}, {QVEC}, sem as (select query_id, case_id, {COSINE.format(a='embedding', b='q')} as score from (select case_id, embedding from own join embeddings on vec_id = case_id // 1000), qvec),
    {top_sql('scores', 'l', 'case_id', 15)}, {top_sql('sem', 's', 'case_id', 15)}, {rrf_sql(['l', 's'], 'fused', 'case_id')}, {top_sql('fused', 'top', 'case_id', 5)} select * from top"""
)
def faq_hybrid(spark, sf):
    """Hybrid search over the cases that a tenant may read."""
    third = F.expr("floor(case_id / 1000) % 3")
    cases = faq(spark, sf).select("case_id", "text", F.when(third == 0, "PUBLIC").when(third == 1, "SRC7").otherwise("SRC8").alias("org_id"))
    own = visible(cases, "SRC7").select("case_id")
    vec = own.join(table(spark, sf, "embeddings"), F.expr("vec_id = floor(case_id / 1000)")).select("case_id", "embedding")
    lex = R.top_k(R.bm25(cases, passages(spark, sf), key="case_id", within=own), ["query_id"], "score", ["case_id"], 15)
    sem = R.dense_top(vec, query_vectors(spark, sf), "case_id", 15)
    return R.top_k(R.rrf([lex, sem], "case_id"), ["query_id"], "score", ["case_id"], 5)


def _hybrid_sql(org, k, name):
    """CTEs that end in `name`: one collection's hybrid search with its own statistics."""
    depth = max(3 * k, 30)
    return f"""{name}_c as (select * from docs where org_id = '{org}'), {bm25_sql(f'{name}_c', 'passages', name=f'{name}_x')}, {name}_d as (select * from dense where doc_id in (select doc_id from {name}_c)),
    {top_sql(f'{name}_x', f'{name}_l', 'doc_id', depth)}, {top_sql(f'{name}_d', f'{name}_s', 'doc_id', depth)}, {rrf_sql([f'{name}_l', f'{name}_s'], f'{name}_f', 'doc_id')}, {top_sql(f'{name}_f', name, 'doc_id', k)}"""


def _collection(spark, sf, org, k):
    d = docs(spark, sf).where(F.col("org_id") == org)
    depth = max(3 * k, 30)
    lex = R.top_k(R.bm25(d.select("doc_id", "text"), passages(spark, sf)), ["query_id"], "score", ["doc_id"], depth)
    sem = R.dense_top(_vectors(spark, sf, d.select("doc_id")), query_vectors(spark, sf), "doc_id", depth)
    return R.top_k(R.rrf([lex, sem], "doc_id"), ["query_id"], "score", ["doc_id"], k)


@query(f"with {DOCS}, {PASS}, {QVEC}, {DENSE}, {_hybrid_sql('SRC9', 5, 'own')} select * from own")
def tenant_hybrid(spark, sf):
    """A tenant's own documents: max(k / 3, 5) of them for a search of 10."""
    return _collection(spark, sf, "SRC9", max(10 // 3, 5))


@query(
    f"""with {DOCS}, {PASS}, {QVEC}, {DENSE}, {_hybrid_sql('PUBLIC', 10, 'pub')}, {_hybrid_sql('SRC9', 5, 'own')},
    u as (select query_id, doc_id, score, 'corpus' as source_type from pub union all select query_id, doc_id, score, 'tenant' from own), {top_sql('u', 'top', 'doc_id', 10)} select * from top"""
)
def tenant_union_search(spark, sf):
    """The corpus and a tenant's documents, merged by fused score."""
    legs = [_collection(spark, sf, o, k).withColumn("source_type", F.lit(s)).drop("rank") for o, k, s in (("PUBLIC", 10, "corpus"), ("SRC9", 5, "tenant"))]
    return R.top_k(legs[0].unionByName(legs[1]), ["query_id"], "score", ["doc_id"], 10)


@query(
    f"""with {PASS}, {bm25_sql('documents', 'passages')}, {QVEC}, {DENSE}, {top_sql('scores', 'l', 'doc_id', 30)}, {top_sql('dense', 's', 'doc_id', 30)},
    w as (select query_id, doc_id, 0.7::double / (60 + rank) as part from l union all select query_id, doc_id, 0.3::double / (60 + rank) from s),
    f as (select query_id, doc_id, round(sum(part * case when lang = 'en' then 1.25::double when lang = 'es' then 0.0::double else 1.0::double end), 8) as score from w join documents using (doc_id) group by all),
    nz as (select * from f where score > 0), {top_sql('nz', 'top', 'doc_id', 10)} select * from top"""
)
def weighted_rrf(spark, sf):
    """Legs weigh 0.7 and 0.3; a boost by document multiplies, a boost of 0 drops it."""
    legs = [_lexical_top(spark, sf, 30), R.dense_top(_vectors(spark, sf), query_vectors(spark, sf), "doc_id", 30)]
    rows = legs[0].select("query_id", "doc_id", (0.7 / (60 + F.col("rank"))).alias("part")).unionByName(legs[1].select("query_id", "doc_id", (0.3 / (60 + F.col("rank"))).alias("part")))
    boost = F.when(F.col("lang") == "en", 1.25).when(F.col("lang") == "es", 0.0).otherwise(1.0)
    f = rows.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("part") * boost), 8).alias("score"))
    return R.top_k(f.where("score > 0"), ["query_id"], "score", ["doc_id"], 10)


_RANKS = ["แบบสัญญา", "พระราชบัญญัติ", "คู่มือ"]
_YEARS = "case doc_id % 5 when 0 then 2535 when 1 then 2549 when 2 then 2560 when 3 then 2569 else null end"


@query(
    f"""with {PASS}, {bm25_sql('documents', 'passages')}, {QVEC}, {DENSE}, {top_sql('scores', 'l', 'doc_id', 30)}, {top_sql('dense', 's', 'doc_id', 30)},
    w as (select query_id, doc_id, 1.0::double / (60 + rank) as part from l union all select query_id, doc_id, 1.0::double / (60 + rank) from s),
    b as (select doc_id, {_YEARS} as year, case doc_id % 3 when 0 then 0.75 when 1 then 1.25 else 1.0 end as kind from documents),
    newest as (select query_id, coalesce(max(year), 2569) as newest from w join b using (doc_id) group by 1),
    f as (select query_id, doc_id, round(sum(part * kind * case when year < 2560 then 0.0 when year is null then 1.0 else greatest(1.05, 1.30 - 0.02 * (newest - year)) end::double), 8) as score from w join b using (doc_id) join newest using (query_id) group by all),
    nz as (select * from f where score > 0), {top_sql('nz', 'top', 'doc_id', 10)} select * from top"""
)
def boosted_rrf(spark, sf):
    """Fusion in which rank and recency of a source weigh its parts; repealed and superseded sources drop out."""
    legs = [_lexical_top(spark, sf, 30), R.dense_top(_vectors(spark, sf), query_vectors(spark, sf), "doc_id", 30)]
    k = F.col("doc_id")
    entry = F.when(k % 5 == 0, "พ.ศ. 2535").when(k % 5 == 1, "พ.ศ. 2549").when(k % 5 == 2, "พ.ศ. 2560").when(k % 5 == 3, "พ.ศ. 2569").otherwise("x")
    named = table(spark, sf, "documents").select(k, F.get(F.array(*map(F.lit, _RANKS)), (k % 3).cast("int")).alias("title"), entry.alias("entry"))
    return R.boosted(legs, named, "doc_id", 10)


@query(f"with {PASS}, {bm25_sql('documents', 'passages')}, {top_sql('scores', 't', 'doc_id', 20)}, f as (select t.* exclude (rank) from t join documents using (doc_id) where contains(lower(source), 'src1')), {top_sql('f', 'top', 'doc_id', 10)} select * from top")
def doc_filter_post(spark, sf):
    """The document filter comes after ranking, over twice the number asked for."""
    t = _lexical_top(spark, sf, 20).drop("rank")
    f = t.join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").where(F.contains(F.lower("source"), F.lit("src1"))).drop("source")
    return R.top_k(f, ["query_id"], "score", ["doc_id"], 10)


# The whole retrieval. Documents and FAQ cases are chunks of one pool; the stand-in for a cross-encoder is the share of a
# variant's terms that the first 1,200 characters of a chunk have.
ORG = "SRC4"
CFG = A.RetrieverConfig(threshold=0.3)


def pool(spark, sf):
    """chunk_id, kind, org_id, title, text: documents and public FAQ cases."""
    d = docs(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.lit("doc").alias("kind"), "org_id", "title", "text")
    f = faq(spark, sf).select(F.concat(F.lit("f"), "case_id").alias("chunk_id"), F.lit("faq").alias("kind"), F.lit("PUBLIC").alias("org_id"), F.substring("question", 1, 40).alias("title"), "text")
    return d.unionByName(f)


def store(spark, sf):
    chunks = pool(spark, sf)
    order = G.successors(table(spark, sf, "documents"), ["source"], "doc_id", 4096)
    pairs = [("seed", "dst", 0), ("dst", "seed", 1)]
    name = lambda c: F.concat(F.lit("d"), c)
    near = [order.select(name(F.col(a)).alias("seed"), name(F.col(b)).alias("dst"), F.lit(o).alias("ord")) for a, b, o in pairs]
    near.append(faq(spark, sf).select(F.expr("concat('d', floor(case_id / 1000))").alias("seed"), F.concat(F.lit("f"), "case_id").alias("dst"), F.lit(-1).alias("ord")))
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("chunk_id"), "embedding")
    return A.Store(chunks, lexical_index(chunks.select("chunk_id", "kind", "org_id", "text"), "pool", "chunk_id"), vectors, near[0].unionByName(near[1]).unionByName(near[2]))


def asked(spark, sf):
    """The variants, one of them twice and one blank: both go when variants are cleaned."""
    v = variants(spark, sf)
    again = v.where("variant_id = 0").select("query_id", F.lit(5).alias("variant_id"), "text")
    return v.unionByName(again).unionByName(again.select("query_id", F.lit(6).alias("variant_id"), F.lit("  ").alias("text")))


def variant_vectors(spark, sf):
    return query_vectors(spark, sf).crossJoin(F.broadcast(spark.range(2).select(F.col("id").cast("int").alias("variant_id"))))  # two variants


def _retrieved(spark, sf, cfg=CFG, scorer=A.overlap):
    return A.retrieve(store(spark, sf), asked(spark, sf), variant_vectors(spark, sf), ORG, cfg, scorer, stored)


def _search_sql(queries, name, k, seen):
    """CTEs that end in `name`: hybrid search of queries (query_id, text, vec) over the pool's rows in `seen`."""
    depth = max(3 * k, 30)
    return f"""{bm25_sql(seen, queries, key='chunk_id', name=f'{name}_x', stats='pool')},
{name}_d as (select query_id, 'd' || vec_id as chunk_id, {COSINE.format(a='e.embedding', b='q.embedding')} as score from embeddings e, (select query_id, embedding from {queries} join embeddings on vec_id = vec) q where 'd' || vec_id in (select chunk_id from {seen})),
{top_sql(f'{name}_x', f'{name}_l', 'chunk_id', depth)}, {top_sql(f'{name}_d', f'{name}_s', 'chunk_id', depth)}, {rrf_sql([f'{name}_l', f'{name}_s'], f'{name}_f', 'chunk_id')}, {top_sql(f'{name}_f', name, 'chunk_id', k)}"""


def _chain_sql(threshold=0.3, end=False, mixed=False, rank_by="primary"):
    """CTEs that end in `result` (query_id, chunk_id, final, origin, position): every stage as SQL of its own."""
    overlap = f"round(len(list_intersect(list_distinct({tok('v.text')}), list_distinct({tok('left(p.text, 1200)')}))) / greatest(len(list_distinct({tok('v.text')})), 1), 6)"
    last = "max(score) filter (where variant_id = 0)" if rank_by == "primary" else "max(score)"
    place = ("(select max(position) from kept k where k.query_id = n.query_id) + i, 1", "(select min(final) from kept k where k.query_id = n.query_id) - 0.001 * i") if end else ("position, r", "final - 0.001")
    return f"""{DOCS}, {FAQ}, {VARIANTS},
pool as (select 'd' || doc_id as chunk_id, 'doc' as kind, org_id, title, text from docs union all select 'f' || case_id, 'faq', 'PUBLIC', left(question, 40), text from faq),
seen as (select * from pool where org_id in ('PUBLIC', '{ORG}')), main as (select * from seen {"" if mixed else "where kind <> 'faq'"}), cases as (select * from seen where kind = 'faq'),
vkey as (select query_id * 10 + variant_id as query_id, text, query_id as vec from variants), vzero as (select query_id, text, query_id as vec from variants where variant_id = 0),
{_search_sql('vkey', 'hit', 40, 'main')},
hits as (select query_id // 10 as query_id, query_id % 10 as variant_id, chunk_id, rank from hit),
fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 8) as score from hits group by all), {top_sql('fused', 'seeds', 'chunk_id', 40)},
matrix as (select s.query_id, v.variant_id, s.chunk_id, {overlap} as score from seeds s join variants v using (query_id) join pool p using (chunk_id)),
scored as (select query_id, chunk_id, {last} as final, max(score) as best from matrix group by all),
passed as (select * exclude (n, top) from (select *, row_number() over (partition by query_id order by best desc, chunk_id) as n, max(best) over (partition by query_id) as top from scored) where best >= {threshold} or (top < {threshold} and n = 1)),
per as (select * from (select m.*, row_number() over (partition by m.query_id, m.variant_id order by m.score desc, m.chunk_id) as r from matrix m join passed using (query_id, chunk_id)) where r <= 4),
slot as (select query_id, chunk_id, min(variant_id * 100 + r) as s from per group by all),
cut as (select *, row_number() over (partition by query_id order by s nulls last, final desc, chunk_id) as n from passed left join slot using (query_id, chunk_id)),
kept as (select query_id, chunk_id, final, row_number() over (partition by query_id order by final desc, chunk_id) as position from cut where n <= 15),
succ as (select doc_id, lead(doc_id) over (partition by source order by doc_id) as nd from documents),
nb as (select 'd' || doc_id as seed, 'd' || nd as dst, 0 as ord from succ where nd is not null union all select 'd' || nd, 'd' || doc_id, 1 from succ where nd is not null union all select 'd' || (case_id // 1000), 'f' || case_id, -1 from faq),
few as (select *, row_number() over (partition by seed order by ord, dst) as r from nb where dst in (select chunk_id from seen)),
got as (select k.query_id, f.dst as chunk_id, k.final, k.position, f.r, row_number() over (partition by k.query_id, f.dst order by k.position, f.r) as n from kept k join few f on f.seed = k.chunk_id where r <= 2),
fresh as (select g.*, row_number() over (partition by g.query_id order by g.position, g.r) as i from got g anti join kept k on k.query_id = g.query_id and k.chunk_id = g.chunk_id where n = 1),
carried as (select query_id, chunk_id, final, origin, row_number() over (partition by query_id order by a, b) as position from (select query_id, chunk_id, final, 'search' as origin, position as a, 0 as b from kept union all select query_id, chunk_id, round({place[1]}, 6), 'graph', {place[0]} from fresh n)),
{_search_sql('vzero', 'cs', 2, 'cases')},
tail as (select c.query_id, c.chunk_id, row_number() over (partition by c.query_id order by c.rank) as i from cs c anti join carried k on k.query_id = c.query_id and k.chunk_id = c.chunk_id),
floor as (select query_id, min(final) as f, max(position) as p from carried group by 1),
result as (select * from carried {"" if mixed else "union all select query_id, chunk_id, round(f - 1 - 0.001 * i, 6), 'faq', p + i from tail join floor using (query_id)"})"""


@query(f"with {_chain_sql()} select query_id, variant_id, chunk_id, score from matrix")
def rerank_matrix(spark, sf):
    s = store(spark, sf)
    v = A.clean_variants(asked(spark, sf))
    pair = F.struct("query_id", "variant_id").alias("query_id")
    hits = A.store_search(s, v.select(pair, "text"), variant_vectors(spark, sf).select(pair, "q"), ORG, 40, excluded=["faq"])
    seeds = A.fuse_variants(hits.select("query_id.query_id", "query_id.variant_id", "chunk_id", "rank"), CFG, "chunk_id").select("query_id", "chunk_id")
    pairs = seeds.join(s.chunks.select("chunk_id", F.substring("text", 1, CFG.rerank_chars).alias("_c")), "chunk_id").join(v, "query_id")
    return pairs.select("query_id", "variant_id", "chunk_id", A.overlap(F.col("text"), F.col("_c")).alias("score"))


@query(f"with {_chain_sql()} select query_id, chunk_id, final, best from passed")
def threshold_floor_one(spark, sf):
    """A chunk that only the second variant finds relevant stays, though its score for the first is lower."""
    return A.passing(A.rerank(rerank_matrix(spark, sf), "chunk_id"), 0.3, "chunk_id").drop("best_variant")


@query(f"with {_chain_sql(threshold=0.9)} select query_id, chunk_id, final, best from passed")
def threshold_high(spark, sf):
    """Most queries pass nothing at 0.9 and keep their single best chunk."""
    return A.passing(A.rerank(rerank_matrix(spark, sf), "chunk_id"), 0.9, "chunk_id").drop("best_variant")


@query(f"with {_chain_sql()}, g as (select *, row_number() over (partition by query_id order by best desc, chunk_id) as n, max(best) over (partition by query_id) as top from scored), h as (select query_id, chunk_id, best as score, row_number() over (partition by query_id order by best desc, chunk_id) as rank from g where best >= 0.2 or (top < 0.2 and n = 1)) select * from h where rank <= 5")
def rerank_gate(spark, sf):
    scored = A.rerank(rerank_matrix(spark, sf), "chunk_id").select("query_id", "chunk_id", F.col("best").alias("score"))
    return A.gate(scored, "chunk_id", 0.20, 5)


@query(f"with {_chain_sql()} select query_id, chunk_id, final, position from kept")
def slot_assembly(spark, sf):
    m = stored(rerank_matrix(spark, sf), "matrix")
    return A.slots(m, A.passing(A.rerank(m, "chunk_id"), 0.3, "chunk_id"), "chunk_id", CFG)


@query(f"with {_chain_sql()} select * from carried")
def neighbour_carry(spark, sf):
    return _retrieved(spark, sf, replace(CFG, faq_k=0))[0]


@query(f"with {_chain_sql(end=True)} select * from carried")
def neighbour_carry_end(spark, sf):
    return _retrieved(spark, sf, replace(CFG, faq_k=0, graph_position="end"))[0]


@query(f"with {_chain_sql()} select * from result")
def faq_separate(spark, sf):
    return _retrieved(spark, sf)[0]


@query(f"with {_chain_sql(mixed=True, rank_by='max')} select * from result")
def faq_mixed(spark, sf):
    """FAQ cases compete with documents, and the best score over the variants orders."""
    return _retrieved(spark, sf, replace(CFG, faq_mode="mixed", rank_by="max"))[0]


@query(f"with {_chain_sql()}, ft as (select query_id, chunk_id, score as final, 'search' as origin, rank as position from seeds where rank <= 15) select query_id, chunk_id, final, position from ft")
def fused_fallback(spark, sf):
    """Without a scorer the fused order decides."""
    return _retrieved(spark, sf, replace(CFG, faq_k=0, graph_per_seed=0), None)[0].drop("origin")


def _moody():
    """A model that fails for questions whose md5 starts with 0 to 3, and gives the share of shared terms for the others."""
    import hashlib

    import regex

    words = lambda t: {w for w in regex.findall(r"[\p{L}\p{N}_]+", t.lower()) if len(w) > 1}

    def scores(pairs):
        if any(hashlib.md5(q.encode()).hexdigest()[0] < "4" for q, _ in pairs):
            raise ConnectionError("the model is away")
        return [round(len(words(q) & words(c)) / max(len(words(q)), 1), 6) for q, c in pairs]

    return scores


@query(
    f"""with {_chain_sql()}, away as (select distinct query_id from variants where md5(text)[1] < '4'),
    f as (select query_id, chunk_id, score as final, rank as position from seeds where rank <= 15 and query_id in (select query_id from away))
    select query_id, chunk_id, final, position from f union all select query_id, chunk_id, final, position from kept where query_id not in (select query_id from away)"""
)
def model_rerank_fallback(spark, sf):
    """A model scores in the executors; the questions for which it fails keep the fused order."""
    return _retrieved(spark, sf, replace(CFG, faq_k=0, graph_per_seed=0), A.PairModel(_moody))[0].drop("origin")


@query(
    f"""with {_chain_sql()}, n as (select query_id, count(*) filter (where origin = 'search') as kept, count(*) filter (where origin = 'graph') as carried, count(*) filter (where origin = 'faq') as faq from result group by 1)
    select query_id, 2 as queries, (select count(distinct chunk_id) from hits h where h.query_id = n.query_id) as recalled, (select count(*) from seeds s where s.query_id = n.query_id) as seeds, kept, carried, faq from n"""
)
def retrieval_stats(spark, sf):
    return _retrieved(spark, sf)[1]


@query(f"with {_chain_sql()} select query_id, chunk_id, position, final, origin, kind, title, org_id, left(text, 300) as preview from result join pool using (chunk_id)")
def retrieve_end_to_end(spark, sf):
    """The flagship: every variant's hybrid search as one tenant, fused, expanded, reranked, thresholded, given slots and
    neighbours, followed by FAQ cases, then hydrated. Tenant filters hold in each leg, before anything is ranked."""
    found, _ = _retrieved(spark, sf)
    chunks = pool(spark, sf).select("chunk_id", "kind", "title", "org_id", F.substring("text", 1, 300).alias("preview"))
    return found.join(chunks, "chunk_id").select("query_id", "chunk_id", "position", "final", "origin", "kind", "title", "org_id", "preview")


@query(f"with {DOCS}, {FAQ}, {LINES} select 'kind:' || kind as key, count(*) as n from (select 'section' as kind from lines union all select 'faq' from faq) group by 1 union all select 'chunks', (select count(*) from lines) + (select count(*) from faq) union all select 'documents', (select count(*) from documents) + (select count(distinct case_id // 1000) from faq) union all select 'faq_pairs', count(*) from faq")
def corpus_manifest(spark, sf):
    """What the corpus of lines and cases holds."""
    pairs = faq(spark, sf)
    chunks = C.lines(table(spark, sf, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.lit("section").alias("kind"))
    chunks = chunks.unionByName(pairs.select(F.expr("concat('f', floor(case_id / 1000))").alias("doc"), F.lit("faq").alias("kind")))
    return C.manifest(chunks, pairs)


_HIDDEN = f"asked as (select item_id as query_id, item_id % 4 as n, array_to_string(list_transform({tok('text')}, lambda x: repeat('qx', item_id % 4) || x), ' ') as hidden, text from benchmark)"


@query(
    f"""with {_HIDDEN}, plain as (select query_id, text from asked where n < 3), {bm25_sql('documents', 'plain')}, {top_sql('scores', 'top', 'doc_id', 3)}
    select query_id, least(n + 1, 3) as searches, doc_id is not null as settled, doc_id, score, rank, case when doc_id is not null then n end as round from asked left join top using (query_id)"""
)
def retry_rounds(spark, sf):
    """Questions that are found as asked, after one and after two rewrites, and never: each word has a false beginning, of
    which a rewrite takes one part off."""
    hide = F.array_join(F.transform(T.tokens(F.col("text")), lambda x: F.concat(F.repeat(F.lit("qx"), (F.col("item_id") % 4).cast("int")), x)), " ")
    asked_ = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), hide.alias("text"))
    index = doc_index(spark, sf)
    hits, states = rounds.ask_in_rounds(asked_, lambda q: R.bm25(index, q), lambda t, _: F.regexp_replace(t, r"(^|\s)qx", "$1"), "doc_id", keep=stored)
    top = R.top_k(hits, ["query_id"], "score", ["doc_id"], 3)
    return states.join(top, "query_id", "left").select("query_id", "searches", "settled", "doc_id", "score", "rank", "round")
