"""Answers: grounding, attribution, audit rows; evaluation: truth, rates, ablations; stores: vectors and parity."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import audit, graph, lookup, metrics, retrieval, writes
from ..operators import corpus as C
from ..operators.embedding import Embedder, EmbeddingCache, hashed
from ..session import visible
from ..sources.snapshots import Catalog
from .corpus_queries import evidence_sql
from .search_queries import CFG, _chain_sql, _retrieved
from .tables import DOCS, FAQ, docs, faq, passages, query, scratch, stored, table


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_SAID = """a as (select o_orderkey as k, case when o_orderkey % 13 = 0 then '' else 'ตามมาตรา ' || o_orderkey % 9 || ' และ ม. ' || o_orderkey % 5 || ' กับข้อ ' || o_orderkey % 3 || ' หนังสือ ว ' || o_orderkey % 4
  || case when o_orderkey % 2 = 0 then ' วิธีเฉพาะเจาะจง' else '' end || case o_orderkey % 4 when 0 then ' ไม่เกิน 1,000,000 บาท' when 1 then ' ไม่เกินวงเงินสองล้านบาท' when 2 then ' ไม่เกินห้าแสนบาท' else ' วงเงิน 700,000 บาท' end
  || case o_orderkey % 3 when 0 then ' สถานศึกษา' when 1 then ' ฉุกเฉิน' else '' end end as answer,
  'มาตรา ' || o_orderkey % 7 || ' ข้อ 1' as context, o_orderkey % 6 as section_num, case when o_orderkey % 5 = 0 then 2 end as clause_num from orders)"""


@query(
    f"""with {_SAID}, c as (select *, list_distinct(regexp_extract_all(answer, '(?:มาตรา|ม\\.)\\s*(\\d+)', 1)) as s, list_distinct(regexp_extract_all(answer, 'ข้อ\\s*(\\d+)', 1)) as cl,
    [cast(k % 7 as varchar)] || case when section_num > 0 then [cast(section_num as varchar)] else [] end as ks, ['1'] || case when clause_num is null then [] else ['2'] end as kc from a),
    u as (select *, len(list_filter(s, lambda x: not list_contains(ks, x))) as bs, len(list_filter(cl, lambda x: not list_contains(kc, x))) as bc from c),
    w as (select *, case when k % 2 = 0 and k % 3 <> 0 and answer <> '' then case k % 4 when 0 then [1000000] when 1 then [2000000] else []::int[] end else []::int[] end as wrong from u)
    select k as o_orderkey, len(s) as n_sections, bs as n_ungrounded_sections, bc as n_ungrounded_clauses, len(list_distinct(regexp_extract_all(answer, 'ว\\s*\\d+'))) as n_circulars, len(wrong) as n_wrong_ceilings,
    round_even(case when answer = '' then 0.0 when len(s) + len(cl) = 0 then 1.0 else (len(s) + len(cl) - bs - bc) / (len(s) + len(cl)) end, 2)::double as score, answer <> '' and not (bs > len(s) / 2) and len(wrong) = 0 as passed from w"""
)
def grounding_audit(spark, sf):
    k = F.col("o_orderkey")
    amount = F.when(k % 4 == 0, " ไม่เกิน 1,000,000 บาท").when(k % 4 == 1, " ไม่เกินวงเงินสองล้านบาท").when(k % 4 == 2, " ไม่เกินห้าแสนบาท").otherwise(" วงเงิน 700,000 บาท")
    case = F.when(k % 3 == 0, " สถานศึกษา").when(k % 3 == 1, " ฉุกเฉิน").otherwise("")
    said = F.concat(T.to_thai(_say("ตามมาตรา ", k % 9)), _say(" และ ม. ", k % 5, " กับข้อ ", k % 3, " หนังสือ ว ", k % 4), F.when(k % 2 == 0, " วิธีเฉพาะเจาะจง").otherwise(""), amount, case)
    a = table(spark, sf, "orders").select(k, F.when(k % 13 == 0, "").otherwise(said).alias("answer"), _say("มาตรา ", k % 7, " ข้อ 1").alias("context"), F.array((k % 6).cast("int")).alias("s"), F.array(F.when(k % 5 == 0, 2)).alias("c"))
    g = audit.grounding(a, F.col("answer"), F.col("context"), F.col("s"), F.col("c"))
    n = lambda c: F.size(c).cast("long")
    return g.select(k, n("sections").alias("n_sections"), n("ungrounded_sections").alias("n_ungrounded_sections"), n("ungrounded_clauses").alias("n_ungrounded_clauses"), n("circulars").alias("n_circulars"), n("wrong_ceilings").alias("n_wrong_ceilings"), "score", "passed")


@query(
    """select l_orderkey * 10 + l_linenumber as quote_id, l_partkey, l_suppkey, case when l_partkey % 5 = 0 then null else 'law' end as law_kind,
    case l_partkey % 5 when 0 then null when 1 then 'own' || l_orderkey || '.pdf' when 2 then 'reg' || l_orderkey || '.md' when 3 then 'store' || l_linenumber || '.md' else null end as filename,
    case l_partkey % 5 when 1 then '3' when 2 then '4-6/42' when 3 then '7/9' end as page from lineitem"""
)
def quote_attribution(spark, sf):
    """Quotes find a tenant chunk by their text, a given chunk by document and unit, the store's unit, or nothing; a unit
    of the same number in another document is not theirs."""
    li = table(spark, sf, "lineitem")
    n, o, case = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey") % 5
    qid = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("quote_id")  # keys of any size stay apart
    law = F.when(case == 0, "").when(case == 1, "หน้าอื่น").when(case == 2, F.concat(F.lit("ระเบียบ ก | "), T.to_thai(_say("ข้อ ", n)))).when(case == 3, _say("พระราชบัญญัติ ข มาตรา ", n)).otherwise(_say("กฎอื่น ข้อ ", n))
    quote = F.when(case == 1, _say("words of the tenant ", o)).otherwise("q")
    quotes = li.select(qid, o.alias("answer_id"), law.alias("law"), quote.alias("quote"))
    some = li.select(o.alias("answer_id")).distinct()
    none = F.lit(None)
    tenant = some.select("answer_id", _say("t", F.col("answer_id")).alias("chunk_id"), F.lit(1).alias("ord"), F.lit("เอกสาร | หน้า 3").alias("entry"), _say("some  words of\nthe tenant ", F.col("answer_id"), " here").alias("text"), F.lit(True).alias("tenant"), none.cast("string").alias("kind"), none.cast("int").alias("num"), F.lit("เอกสาร").alias("doc"))
    given = li.select(o.alias("answer_id"), n).distinct().select("answer_id", _say("r", F.col("answer_id"), "-", n).alias("chunk_id"), (n + 1).cast("int").alias("ord"), _say("ระเบียบ ก | ข้อ ", n).alias("entry"), F.lit("x").alias("text"), F.lit(False).alias("tenant"), F.lit("clause").alias("kind"), n.cast("int").alias("num"), F.lit("ระเบียบ ก").alias("doc"))
    page = lambda a, b, c: [F.lit(a).cast("int").alias("page_start"), F.lit(b).cast("int").alias("page_end"), F.lit(c).cast("int").alias("total_pages")]
    unit = lambda kind, doc: [F.lit(kind).cast("string").alias("kind"), F.lit(doc).alias("doc")]
    records = tenant.select("chunk_id", _say("own", F.col("answer_id"), ".pdf").alias("source_file"), F.lit("เอกสาร").alias("title"), *page(3, 3, None), *unit(None, "เอกสาร"), none.cast("int").alias("num"))
    records = records.unionByName(given.select("chunk_id", _say("reg", F.col("answer_id"), ".md").alias("source_file"), F.lit("ระเบียบ ก").alias("title"), *page(4, 6, 42), *unit(None, "ระเบียบ ก"), none.cast("int").alias("num")))
    records = records.unionByName(li.select(n).distinct().select(_say("s", n).alias("chunk_id"), _say("store", n, ".md").alias("source_file"), F.lit("พระราชบัญญัติ ข").alias("title"), *page(7, 7, 9), *unit("section", "พระราชบัญญัติ ข"), n.cast("int").alias("num")))
    got = audit.attribute_quotes(quotes, tenant.unionByName(given), records)
    return got.select((F.col("quote_id.l_orderkey") * 10 + F.col("quote_id.l_linenumber")).alias("quote_id"), "quote_id.l_partkey", "quote_id.l_suppkey", F.when(F.col("law").isNotNull(), "law").alias("law_kind"), "filename", "page")


@query("select o_orderkey as query_id, 'ORG' || o_custkey % 3 as org_id, o_orderpriority as user_query, case when o_orderkey % 4 = 0 then 'ERROR' when o_orderkey % 4 = 1 then null else 'COMPLIANT' end as status, case when o_orderkey % 4 < 2 then 0 else 2 end as n_clauses, case when o_orderkey % 4 < 2 then null else o_orderkey % 4 = 2 end as grounded, o_custkey as latency_ms, case when o_orderkey % 4 = 0 then 'late' end as error from orders")
def audit_rows(spark, sf):
    k = F.col("o_orderkey")
    result = F.when(k % 4 >= 2, F.struct(F.lit("COMPLIANT").alias("status"), F.array(F.lit("a"), F.lit("b")).alias("clause_ids"), F.array(F.lit("law")).alias("laws"), F.lit("yes").alias("answer"), (k % 4 == 2).alias("passed"), F.lit(1.0).alias("score")))
    a = table(spark, sf, "orders").select(k.alias("query_id"), _say("ORG", F.col("o_custkey") % 3).alias("org_id"), F.col("o_orderpriority").alias("question"), result.alias("result"), F.when(k % 4 == 0, "late").alias("error"), F.col("o_custkey").alias("latency_ms"))
    return audit.audit_rows(a).select("query_id", "org_id", "user_query", "status", F.size("retrieved_clause_ids").cast("long").alias("n_clauses"), "grounded", "latency_ms", "error")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'N' then 'PARTIALLY_RESOLVED' else 'OPEN' end as status, case when l_suppkey % 3 = 0 then null else 'needs ' || l_suppkey end as missing_aspect from lineitem where l_returnflag <> 'A' and l_linestatus = 'O'")
def unresolved_issues(spark, sf):
    li = table(spark, sf, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 2 == 0, "RESOLVED")).when(F.col("l_returnflag") == "A", "RESOLVED").when(F.col("l_returnflag") == "N", "PARTIALLY_RESOLVED").otherwise("OPEN")
    aspect = F.when(F.col("l_suppkey") % 3 == 0, F.when(F.col("l_suppkey") % 2 == 0, " N/A ").otherwise("ไม่มี")).otherwise(_say(" needs ", F.col("l_suppkey")))
    return audit.unresolved(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"), aspect.alias("missing_aspect")))


@query("select o_orderkey as pred_id, case when o_orderkey % 3 = 0 then o_orderkey when o_orderkey % 3 = 1 then o_orderkey + 1000000000 end as case_key from orders")
def result_truth(spark, sf):
    """Predictions meet their case by id, else by the trimmed question; others stay without a case."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    first = o.select(k.cast("string").alias("case_id"), k.alias("ord"), _say("by id ", k).alias("question"), k.alias("case_key"))
    second = o.select(_say("other", k).alias("case_id"), (k + 1_000_000_000).alias("ord"), _say(" asked ", k, " ").alias("question"), (k + 1_000_000_000).alias("case_key"))
    wanted = F.when(k % 3 == 0, k.cast("string")).otherwise(_say("none", k))
    question = F.when(k % 3 == 1, _say("asked ", k, "  ")).otherwise(_say("nowhere ", k))
    p = o.select(k.alias("pred_id"), k.alias("ord"), wanted.alias("case_id"), question.alias("question"))
    return metrics.match_predictions(p, first.unionByName(second)).select("pred_id", "case_key")


@query("select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean from orders where o_orderkey % 5 not in (0, 1) and o_orderkey % 7 <> 0 group by 1")
def no_law_left_out(spark, sf):
    """Answers without law, by status or by what they say, don't count in the means."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "NO_LAW_FOUND").otherwise("COMPLIANT")
    answer = F.when(k % 5 == 1, "ขออภัย ไม่พบข้อกฎหมาย").when(k % 7 == 0, "NO_LAW_FOUND").otherwise("yes")
    rows = table(spark, sf, "orders").withColumns({"status": status, "answer": answer})
    return metrics.with_law(rows).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("with c as (select o_orderkey % 3 = 0 as d, o_orderkey % 4 = 0 as s, (o_orderkey % 5) / 5 as r from orders) select count(*) as total_cases, count(*) filter (where d) as document_hits, round(count(*) filter (where d) * 100 / count(*), 4) as document_hit_rate, count(*) filter (where s) as section_hits, round(count(*) filter (where s) * 100 / count(*), 4) as section_hit_rate, count(*) filter (where d and s) as strict_hits, round(count(*) filter (where d and s) * 100 / count(*), 4) as strict_hit_rate, round(avg(r) * 100, 4) as mean_recall_at_k from c")
def hit_rates(spark, sf):
    k = F.col("o_orderkey")
    return metrics.hit_rates(table(spark, sf, "orders").select((k % 3 == 0).alias("document_hit"), (k % 4 == 0).alias("section_hit"), (k % 5 / 5).alias("recall")))


# Evidence: a passage's evidence is the first document that holds it, one that does not, and markup that doesn't count.
_EVIDENCE = "truth as (select item_id as query_id, min(doc_id) as doc from benchmark b join documents d on contains(d.text, b.text) group by 1), spans as (select query_id, unnest([1, 2, 3, 4]) as span_id, doc, text from truth join benchmark on item_id = query_id)"
_HITS = f"""res as (select query_id, position as rank, cast(substr(chunk_id, 2) as bigint) as doc_id from result where origin <> 'faq' and chunk_id[1] = 'd'), texts as (select r.query_id, r.rank, r.doc_id, {evidence_sql("d.text")} as t from res r join documents d using (doc_id) where rank <= 10),
found as (select t.query_id, t.rank, s.span_id from texts t join spans s on s.query_id = t.query_id and s.doc = t.doc_id where (span_id = 1 and contains(t, {evidence_sql("s.text")})) or (span_id = 2 and contains(t, {evidence_sql("left(s.text, 40)")})))"""


def _evidence_spans(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text")
    b = passages(spark, sf)
    first = graph.link_titles(d, b.select(F.col("query_id").alias("doc_id"), F.col("text").alias("title")), stored).groupBy(F.col("doc_id").alias("query_id")).agg(F.min("case_id").alias("doc"))
    said = lambda i, doc, span: F.struct(F.lit(i).alias("span_id"), doc.alias("doc"), span.alias("span"))
    own, t = _say("corpus/doc_", F.col("doc"), "_end.md"), F.col("text")
    spans = F.array(said(1, own, t), said(2, own, F.concat(F.lit("<b>"), F.lower(F.substring(t, 1, 40)), F.lit("</b> | “”"))), said(3, own, F.lit("no such span")), said(4, F.lit("doc_none.md"), t))
    return first.join(b, "query_id").select("query_id", F.explode(spans).alias("s")).select("query_id", "s.*")


def _evidence_results(spark, sf, found):
    texts = table(spark, sf, "documents").select(_say("d", F.col("doc_id")).alias("chunk_id"), _say("doc_", F.col("doc_id"), "_end").alias("doc"), "text")
    found = stored(found.where("origin <> 'faq'").select("query_id", "chunk_id", "position"), "found")  # a few rows a question
    return texts.join(retrieval.small(found, found.count()), "chunk_id").select("query_id", F.col("position").alias("rank"), "doc", "text")


@query(
    f"""with {_chain_sql()}, {_EVIDENCE}, {_HITS}, c as (select query_id, count(*) as c from texts group by 1), f as (select query_id, count(distinct span_id) as f, min(rank) as first, count(distinct rank) as good from found group by 1)
    select query_id, round(coalesce(f, 0) / 4, 4) as recall, cast(coalesce(f, 0) > 0 as int) as hit, cast(coalesce(f, 0) = 4 as int) as all_found, round(coalesce(1.0::double / first, 0.0::double), 4) as mrr, round(coalesce(coalesce(good, 0) / c, 0.0::double), 4) as precision from truth left join f using (query_id) left join c using (query_id)"""
)
def evidence_metrics(spark, sf):
    """Evidence counts in its own document only, and markup, case and quotes don't matter."""
    return metrics.evidence(_evidence_results(spark, sf, _retrieved(spark, sf)[0]), stored(_evidence_spans(spark, sf), "spans"), 10)


@query(
    f"""with {_chain_sql()}, {_EVIDENCE}, {_HITS}, f as (select query_id, count(distinct span_id) as f from found group by 1)
    select case when length(b.text) % 2 = 0 then 'text' else 'table' end as question_type, count(*) as n, round(avg(coalesce(f, 0) / 4), 4) as recall, round(avg(cast(coalesce(f, 0) > 0 as int)), 4) as hit from truth t join benchmark b on item_id = t.query_id left join f on f.query_id = t.query_id group by 1"""
)
def type_summaries(spark, sf):
    """Means by question type."""
    m = evidence_metrics(spark, sf).join(passages(spark, sf), "query_id").withColumn("question_type", F.when(F.length("text") % 2 == 0, "text").otherwise("table"))
    return m.groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("hit"), 4).alias("hit"))


_SYSTEMS = {"new": "select query_id, chunk_id, position from carried", "new_nograph": "select query_id, chunk_id, position from kept", "new_norerank": "select query_id, chunk_id, rank as position from seeds where rank <= 15"}


@query(
    f"with {_chain_sql()}, {_EVIDENCE}, sys as ("
    + " union all ".join(f"select '{k}' as system, * from ({v})" for k, v in _SYSTEMS.items())
    + "), ks as (select unnest([5, 10, 20]) as k), h as (select system, k, query_id, min(position) as first from sys join truth using (query_id) cross join ks where position <= k and chunk_id = 'd' || doc group by all) select system, k, round(count(*) / (select count(*) from truth), 4) as hit, round(sum(round(1.0::double / first, 4)) / (select count(*) from truth), 4) as mrr from h group by 1, 2"
)
def ablations(spark, sf):
    """The same questions through the whole retrieval, without graph expansion, and without rerank; hit and MRR at cut-offs."""
    runs = {"new": (replace(CFG, faq_k=0), A.overlap), "new_nograph": (replace(CFG, faq_k=0, graph_per_seed=0), A.overlap), "new_norerank": (replace(CFG, faq_k=0, graph_per_seed=0), None)}
    truth = stored(_evidence_spans(spark, sf).where("span_id = 1").select("query_id", F.regexp_extract("doc", r"doc_(\d+)_", 1).alias("doc")).select("query_id", F.concat(F.lit("d"), "doc").alias("item")), "truth")
    out = None
    for name, (cfg, scorer) in runs.items():
        found = _retrieved(spark, sf, cfg, scorer)[0].select("query_id", F.col("chunk_id").alias("item"), F.col("position").alias("rank"))
        m = metrics.at_cutoffs(found, truth, [5, 10, 20]).join(truth.select("query_id"), "query_id", "left_semi")
        m = m.groupBy("k").agg(F.round(F.avg("hit"), 4).alias("hit"), F.round(F.avg("mrr"), 4).alias("mrr")).where("hit > 0").withColumn("system", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("system", F.col("k").cast("long"), "hit", "mrr")


_WINDOWS = "w as (select doc_id, s, substr(text, s + 1, 1000) as chunk from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) as s from documents where length(text) > 0) where s = 0 or s + 200 < length(text))"


@query(
    f"""with {_WINDOWS}, e as (select doc_id, unnest([1, 2, 3]) as span_id, text from documents), s as (select doc_id, span_id, {evidence_sql("case when span_id = 2 then substr(text, 701, 400) else substr(text, 901, 150) end")} as span from e)
    select s.doc_id, span_id, coalesce(bool_or(span <> '' and span_id < 3 and contains({evidence_sql("chunk")}, span)), false) as intact from s left join w using (doc_id) group by all"""
)
def evidence_intact(spark, sf):
    """Whether some chunk of the span's document holds it whole: chunking may cut a span, another document doesn't count."""
    d = table(spark, sf, "documents")
    own = _say("x/doc_", F.col("doc_id"), "_end.md")
    chunks = d.select("doc_id", F.explode(C.overlapping_windows(F.col("text"))).alias("chunk")).select("doc_id", _say("doc_", F.col("doc_id"), "_end").alias("doc"), F.col("chunk").alias("text"))
    span = lambda i, doc, a, n: F.struct(F.lit(i).alias("span_id"), doc.alias("doc"), F.substring("text", a, n).alias("span"))
    spans = d.select("doc_id", F.explode(F.array(span(1, own, 901, 150), span(2, own, 701, 400), span(3, F.lit("doc_none.md"), 901, 150))).alias("s")).select("doc_id", "s.*")
    found = metrics.holds_evidence(chunks, spans, ["doc_id"]).select("doc_id", "span_id").distinct().withColumn("intact", F.lit(True))
    return spans.select("doc_id", "span_id").join(found, ["doc_id", "span_id"], "left").withColumn("intact", F.coalesce("intact", F.lit(False)))


# Stores.
_POINTS = f"with {DOCS}, p as (select doc_id, org_id, '[' || title || ']' || chr(10) || text as t from docs where org_id <> 'PUBLIC')"
_VECTOR = "list_transform(range(8), lambda i: round(('0x' || substr(md5(t), 4 * i + 1, 4))::bigint / 65535, 9))"


def _embedder(fail=0):
    """The stand-in model behind a provider that fails and one that answers short."""

    def broken(texts):
        raise ConnectionError("no service")

    return Embedder((broken, lambda texts: hashed()(texts)[1:], hashed()), tries=3)


@query(f"{_POINTS} select doc_id, org_id, {_VECTOR} as embedding from p")
def rebuild_tenant_index(spark, sf):
    """All tenants' vectors made anew through the chain of providers, written as a snapshot, and read back."""
    d = docs(spark, sf).where("org_id <> 'PUBLIC'").select("doc_id", "org_id", _say("[", F.col("title"), "]\n", F.col("text")).alias("t"))
    catalog = Catalog(spark, scratch(spark, "vectors"))
    catalog.publish({"points": _embedder().column(d, "t").select("doc_id", "org_id", "embedding")}, partition_by={"points": "org_id"})
    return catalog.read("points").select("doc_id", "org_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query(f"{_POINTS} select doc_id, org_id, {_VECTOR} as embedding from p")
def embedding_cache(spark, sf):
    """The same vectors from a cache: half of the texts are embedded first, then all are asked for, of which the cache has
    that half."""
    d = docs(spark, sf).where("org_id <> 'PUBLIC'").select("doc_id", "org_id", _say("[", F.col("title"), "]\n", F.col("text")).alias("t"))
    cache = EmbeddingCache(spark, scratch(spark, "embedding-cache"), "hashed 8", few=0)
    cache.column(d.where("doc_id % 2 = 0"), ["doc_id"], "t", _embedder())
    got = cache.column(d, ["doc_id", "org_id"], "t", _embedder())
    return got.select("doc_id", "org_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query(f"with {DOCS} select org_id, count(*) as n_rows, count(*) filter (where doc_id % 4 <> 0) as n_points, count(*) filter (where doc_id % 4 = 0) as n_missing, count(*) filter (where doc_id % 4 = 0) = 0 as parity from docs group by 1")
def store_parity(spark, sf):
    """Rows of the relational store without a point in the vector store, by tenant."""
    d = docs(spark, sf).select("doc_id", "org_id")
    return lookup.parity(d, d.where("doc_id % 4 <> 0").select("doc_id"), "doc_id", "org_id")


@query(f"with {FAQ}, t as (select case_id, unnest([1, 2]) as rank from faq) select case_id, rank, case when case_id % 3 = 0 then '' else question end as question, case when case_id % 3 = 0 then '' else answer end as answer from t join faq using (case_id)")
def faq_hydrate(spark, sf):
    """Hits keep their place when the row behind them is missing."""
    f = faq(spark, sf)
    hits = f.select("case_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    return lookup.hydrate(hits, f.where("case_id % 3 <> 0"), ["case_id"], {"question": "", "answer": ""})


@query(f"with {FAQ} select case_id // 1000 as chunk, case_id, left(question, 80) as question from faq where case_id % 4 in (0, 1)")
def related_cases(spark, sf):
    """FAQ cases that relate to a chunk, public ones (also without an owner) and the tenant's own."""
    f = faq(spark, sf)
    k = F.col("case_id") % 4
    cases = f.select("case_id", "question", F.when(k == 1, "SRC4").when(k == 2, "SRC5").when(k == 3, "SRC6").alias("org_id"))
    links = f.select("case_id", F.floor(F.col("case_id") / 1000).cast("long").alias("chunk"))
    return graph.related_cases(links, cases, "SRC4")


@query(
    """with u as (select *, case when l_returnflag = 'A' then 'section' when l_returnflag = 'N' then 'clause' end as kind, case l_linestatus when 'F' then 'ACT' else 'REGULATION' end as level, l_suppkey % 3 as part from lineitem), s as (select l_orderkey, count(*) as doc_units from u where kind is not null group by 1)
    select l_linenumber as number, l_partkey as cited, l_orderkey as doc_id, kind, level, doc_units, part, row_number() over (partition by l_linenumber, l_partkey order by ((kind = 'section' and level = 'ACT') or (kind = 'clause' and level = 'REGULATION')) desc, doc_units desc, part, l_orderkey || ' ' || l_suppkey) as rank from u join s using (l_orderkey) where kind is not null"""
)
def lookup_local_order(spark, sf):
    """Sections and clauses in one ranking."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "section").when(F.col("l_returnflag") == "N", "clause")
    u = li.select(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("cited"), F.col("l_orderkey").alias("doc_id"), kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "ACT").otherwise("REGULATION").alias("level"), (F.col("l_suppkey") % 3).alias("part"), F.concat_ws(" ", "l_orderkey", "l_suppkey").alias("entry"))
    keys = ["number", "cited"]
    return lookup.lookup_local(u.select(*keys).distinct(), u, keys).select("number", "cited", "doc_id", "kind", "level", "doc_units", "part", "rank")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 'allowed up to ' || o_custkey || ' baht' else 'see (the other) part ' || o_custkey end as answer from orders")
def scrub_references(spark, sf):
    """Bracketed references go, other brackets stay, spaces collapse."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(k % 2 == 0, F.concat(F.lit("allowed (มาตรา "), T.to_thai(c.cast("string")), _say(" วรรคสอง)  up to ", c, " baht [ข้อ 7]"))).otherwise(_say("see (the other) part ", c))
    return table(spark, sf, "orders").select(k, T.strip_references(said).alias("answer"))


@query(
    """with l as (select l_orderkey as query_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rank, l_partkey, l_suppkey from lineitem)
    select query_id, string_agg('[Doc ' || l_partkey || ']' || chr(10) || 'part ' || l_suppkey, chr(10) || chr(10) order by rank) as context from l where rank <= 3 group by 1"""
)
def answer_context(spark, sf):
    """The first hits of each question as text blocks, digits Arabic."""
    from ..engine import Engine

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.row_number().over(w).alias("rank"), _say("Doc ", F.col("l_partkey")).alias("entry"), T.to_thai(_say("part ", F.col("l_suppkey"))).alias("content"))
    return Engine.context(hits, 3)


_SAID = "case when l_linenumber % 3 = 1 then 'มาตรา ' || l_partkey || ' วรรคหนึ่ง' when l_linenumber % 3 = 2 then ' (' || l_linenumber || ') (ก) ' else 'บทนำ' end"


@query(
    f"""with s as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, l_linenumber, l_partkey, {_SAID} as section from lineitem),
    u as (select *, last_value(case when l_linenumber % 3 = 1 then 'มาตรา ' || l_partkey end ignore nulls) over (partition by doc order by pos rows between unbounded preceding and current row) as unit from s)
    select doc, pos, case when l_linenumber % 3 = 2 and unit is not null then unit || ' ' || trim(section) else section end as section from u"""
)
def inherited_units(spark, sf):
    """Sections of bare items take the unit that was named before them in their document."""
    said = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("มาตรา "), F.col("l_partkey").cast("string"), F.lit(" วรรคหนึ่ง"))).when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit(" ("), F.col("l_linenumber").cast("string"), F.lit(") (ก) "))).otherwise("บทนำ")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), pos.alias("pos"), said.alias("section"))
    return metrics.with_inherited_units(rows, ["doc"], "pos")
