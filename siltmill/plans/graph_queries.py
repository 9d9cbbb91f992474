"""Graph, look-up, writes, metrics, audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, graph, lookup, metrics, retrieval, writes
from .search_queries import PASS, _lexical_top
from .tables import DOCS, EDGES, FAQ, NEXT, UNITS, bm25_sql, docs, edges, faq, passages, query, reading_order, stored, table, tok, top_sql, units


@query(f"with {UNITS}, {NEXT} select src, dst, 'next' as direction from nexts union all select dst, src, 'previous' from nexts")
def adjacent_edges(spark, sf):
    return graph.both_ways(reading_order(spark, sf))


@query(
    f"""with {UNITS}, {EDGES}, raw as (select src, dst, rel, 0 as ord from edges union all select src, dst, 'CITES_CLAUSE', 1 from edges where src % 3 = 0)
    select src, dst, rel from (select *, row_number() over (partition by src, dst order by case rel when 'EMPOWERED_BY' then 0 else 1 end, ord, rel) as n from raw) where n = 1"""
)
def edge_dedupe_priority(spark, sf):
    e = edges(spark, sf)
    raw = e.withColumn("ord", F.lit(0)).unionByName(e.where("src % 3 = 0").withColumns({"rel": F.lit("CITES_CLAUSE"), "ord": F.lit(1)}))
    return graph.one_relation(raw, {"EMPOWERED_BY": 0, "CITES_CLAUSE": 1}).drop("ord")


@query(f"with {UNITS}, h as (select * from (select *, row_number() over (partition by cited order by number, unit) as n from units) where n = 1) select u.unit as src, h.unit as dst, 'CITES_CLAUSE' as rel from units u join h using (cited) where u.unit <> h.unit")
def citation_resolve(spark, sf):
    u = units(spark, sf)
    h = graph.heads(u, ["cited"], ["number", "unit"]).select("cited", F.col("unit").alias("head"))
    return graph.resolve(u.select("unit", "cited"), h, ["cited"], "unit", "head", F.lit("CITES_CLAUSE"))


@query(f"with {UNITS}, {EDGES} select unit as seed, dst, rel, level from units join edges on src = unit where number = 1")
def one_hop_batch(spark, sf):
    seeds = units(spark, sf).where("number = 1").select(F.col("unit").alias("seed"))
    hop = graph.hop(seeds, edges(spark, sf))
    return hop.join(units(spark, sf).select(F.col("unit").alias("seed"), "level"), "seed").select("seed", "dst", "rel", "level")


@query(f"with {UNITS}, {NEXT} select src, dst from nexts union select dst, src from nexts")
def adjacency_both(spark, sf):
    return graph.adjacency(reading_order(spark, sf))


_SUB = f"{UNITS}, {EDGES}, sub as (select e.dst as seed, e.src, s.doc_id as src_doc, max(rel) as rel from edges e join units s on s.unit = e.src join units d on d.unit = e.dst where s.doc_id <> d.doc_id group by all)"


@query(f"with {_SUB} select * from sub")
def subordinates(spark, sf):
    return _subordinates(spark, sf)


def _subordinates(spark, sf):
    u = units(spark, sf).select("unit", F.col("doc_id").alias("doc"))
    return graph.subordinates(u.select(F.col("unit").alias("seed")), edges(spark, sf), u)


@query(f"with {UNITS}, {EDGES}, b as (select src, dst, rel from edges union select src, src - 1, 'CITES_CLAUSE' from edges union select src, src - 2, 'EMPOWERED_BY' from edges), o as (select src as seed, dst, rel, row_number() over (partition by src order by case rel when 'EMPOWERED_BY' then 0 else 1 end, rel, dst) as ord from b) select * from o where ord <= 2")
def expand_batch(spark, sf):
    """Two neighbours of each seed, what empowers it first."""
    e = edges(spark, sf)
    more = [e.select("src", (F.col("src") - n).alias("dst"), F.lit(r).alias("rel")) for n, r in ((1, "CITES_CLAUSE"), (2, "EMPOWERED_BY"))]
    return graph.expand(e.select(F.col("src").alias("seed")).distinct(), e.unionByName(more[0]).unionByName(more[1]), 2)


@query(f"with {UNITS} select doc_id, count(*) as n from units group by 1 order by n desc, doc_id")
def doc_clusters(spark, sf):
    return units(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id")


_TITLES = "titles as (select item_id as doc_id, array_to_string(string_split(text, ' ')[1:2], ' ') as title from benchmark)"


@query(f"with {_TITLES} select d.doc_id as case_id, t.doc_id from documents d join titles t on contains(d.text, t.title)")
def faq_doc_theta(spark, sf):
    titles = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_join(F.slice(F.split("text", " ", -1), 1, 2), " ").alias("title"))
    return graph.link_titles(table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text"), titles, stored)


@query(
    f"""with {_SUB}, {NEXT}, adj as (select src, dst from nexts union select dst, src from nexts)
    select src as seed, dst, 'adjacent' as relation from adj union all select src, dst, 'cites' from edges union all select seed, src, 'subordinate' from sub union all select unit, -cited, 'case' from units where page < 10"""
)
def related_union(spark, sf):
    return graph.related(
        {
            "adjacent": graph.adjacency(reading_order(spark, sf)).withColumnRenamed("src", "seed"),
            "cites": edges(spark, sf).withColumnRenamed("src", "seed"),
            "subordinate": _subordinates(spark, sf).withColumnRenamed("src", "dst"),
            "case": units(spark, sf).where("page < 10").select(F.col("unit").alias("seed"), (-F.col("cited")).alias("dst")),  # ids of cases
        }
    )


@query(f"with {UNITS} select * from (select unit as src, lead(unit) over (partition by doc_id order by number, unit) as dst from units) where dst is not null")
def next_chunk_chain(spark, sf):
    return graph.chain(units(spark, sf), ["doc_id"], ["number", "unit"], "unit")


_OWNER = "case when doc_id % 7 = 0 then 'PUBLIC' else 'T' || doc_id % 7 end"


@query(f"with {UNITS}, {EDGES} select s.org_id, src as tenant_chunk, dst as target_chunk from edges join (select unit, {_OWNER} as org_id from units) s on s.unit = src join (select unit, {_OWNER} as org_id from units) t on t.unit = dst where s.org_id <> 'PUBLIC' and t.org_id in ('PUBLIC', s.org_id)")
def tenant_citations(spark, sf):
    """Citations of every tenant's own chunks, to what that tenant may read."""
    owner = F.when(F.col("doc_id") % 7 == 0, "PUBLIC").otherwise(F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")))
    u = units(spark, sf).select("unit", owner.alias("org_id"))
    own = u.where("org_id <> 'PUBLIC'").select("org_id", F.col("unit").alias("tenant_chunk"))
    links = own.join(edges(spark, sf), F.col("tenant_chunk") == F.col("src")).join(u.select(F.col("unit").alias("target_chunk"), F.col("org_id").alias("_of")), F.col("dst") == F.col("target_chunk"))
    return links.where("_of in ('PUBLIC', org_id)").select("org_id", "tenant_chunk", "target_chunk")


_LOOK = "row_number() over (partition by number, cited order by (level = 'ACT') desc, page asc nulls last, length(entry), entry) as rank"


@query(f"with {UNITS} select number, cited, unit, level, page, entry, {_LOOK} from units")
def lookup_section_order(spark, sf):
    u = units(spark, sf)
    return lookup.lookup_section(u.select("number", "cited").distinct(), u, ["number", "cited"]).select("number", "cited", "unit", "level", "page", "entry", "rank")


@query(
    f"""with {UNITS}, s as (select doc_id, count(*) as doc_units from units group by 1)
    select number, cited, unit, level, doc_units, row_number() over (partition by number, cited order by case level when 'REGULATION' then 0 when 'MINISTERIAL_RULE' then 1 else 2 end, doc_units desc, page asc nulls last, length(entry), entry) as rank from units join s using (doc_id)"""
)
def lookup_clause_order(spark, sf):
    u = units(spark, sf)
    return lookup.lookup_clause(u.select("number", "cited").distinct(), u, ["number", "cited"]).select("number", "cited", "unit", "level", "doc_units", "rank")


@query(
    f"""with {UNITS}, r as (select number, cited, doc_id, {_LOOK} from units), f as (select number, cited, doc_id, min(rank) as rank from r group by all),
    o as (select *, row_number() over (partition by number, cited order by rank) as n from f)
    select number, cited, min(doc_id) filter (where n = 1) as best_doc, coalesce(string_agg(cast(doc_id as varchar), ',' order by n) filter (where n between 2 and 6), '') as others from o group by all"""
)
def lookup_ambiguous(spark, sf):
    u = units(spark, sf)
    r = lookup.lookup_section(u.select("number", "cited").distinct(), u, ["number", "cited"])
    return lookup.ambiguous(r, ["number", "cited"], "doc_id").select("number", "cited", "best_doc", F.array_join(F.transform("other_docs", lambda x: x.cast("string")), ",").alias("others"))


@query(
    f"""with {UNITS}, refs as (select distinct number, cited from units), s as (select number, cited, unit, 'section' as kind from units where level = 'ACT'),
    c as (select number, cited, unit, 'clause' as kind from units where level <> 'ACT') select * from s union all select c.* from c anti join s on s.number = c.number and s.cited = c.cited"""
)
def lookup_bare_number(spark, sf):
    u = units(spark, sf).select("number", "cited", "unit", "level")
    keys = ["number", "cited"]
    return lookup.by_kind(u.where("level = 'ACT'").drop("level"), u.where("level <> 'ACT'").drop("level"), keys).select("number", "cited", "unit", "kind")


@query("with n as (select c_custkey as doc_id, c_name as title, c_nationkey as org_id, c_acctbal, count(o_orderkey) as n_chunks from customer left join orders on o_custkey = c_custkey group by all) select doc_id, title, n_chunks, row_number() over (partition by org_id order by c_acctbal desc nulls last, doc_id) as position from n")
def tenant_doc_listing(spark, sf):
    """Each tenant's documents with their chunk counts, the newest first (an account balance stands in for a date)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("org_id"), F.col("c_acctbal").alias("created"))
    return lookup.listing(c, table(spark, sf, "orders").withColumnRenamed("o_custkey", "doc_id"), created="created").select("doc_id", "title", "n_chunks", "position")


@query("select ps_name as title, n_name as nation, r_name as region, count(*) as n from (select c_nationkey as nk, 'customer' as ps_name from customer union all select s_nationkey, 'supplier' from supplier) join nation on n_nationkey = nk join region on r_regionkey = n_regionkey group by all")
def org_hierarchy(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nk"), F.lit("customer").alias("title")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nk"), F.lit("supplier").alias("title")))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.join(n, F.col("n_nationkey") == F.col("nk")).groupBy("title", F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"))


# Writes. A second version of some rows stands in for an incoming batch.
_NEW = "incoming as (select doc_id, lang, 'v2' as source, '2024-02-01' as created_at from documents where doc_id % 3 = 0 union all select doc_id + 1000000, lang, source, '2024-02-01' from documents where doc_id % 10 = 0)"
_OLD = "existing as (select doc_id, lang, source, '2024-01-01' as created_at from documents)"


def _versions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    old = d.withColumn("created_at", F.lit("2024-01-01"))
    new = d.where("doc_id % 3 = 0").withColumn("source", F.lit("v2")).unionByName(d.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 1000000)).withColumn("created_at", F.lit("2024-02-01"))
    return old, new


@query(f"with {_OLD}, {_NEW} select * from existing where doc_id not in (select doc_id from incoming) union all select n.doc_id, n.lang, n.source, coalesce(e.created_at, n.created_at) from incoming n left join existing e using (doc_id)")
def upsert_documents(spark, sf):
    old, new = _versions(spark, sf)
    return writes.upsert(old, new, ["doc_id"], ["created_at"])


@query(f"with {_OLD}, {_NEW} select * from existing where lang not in (select lang from incoming where lang <> 'de') union all select * from incoming where lang <> 'de'")
def replace_document(spark, sf):
    old, new = _versions(spark, sf)
    return writes.replace_parts(old, new.where("lang <> 'de'"), ["lang"])


@query(f"with {DOCS} select doc_id, org_id from docs where org_id <> 'SRC6'")
def delete_corpus(spark, sf):
    d = docs(spark, sf).select("doc_id", "org_id")
    return writes.delete_matching(d, d.where("org_id = 'SRC6'"), ["org_id"])


@query(f"with {DOCS} select doc_id, org_id from docs where not (org_id = 'SRC8' and doc_id % 2 = 0)")
def delete_tenant_doc(spark, sf):
    """A tenant deletes half of its documents; the same ids of other tenants stay."""
    d = docs(spark, sf).select("doc_id", "org_id")
    return writes.delete_matching(d, d.where("org_id = 'SRC8' and doc_id % 2 = 0"), ["doc_id", "org_id"])


@query(f"with {UNITS}, {EDGES} select src, dst, rel from edges where not (rel = 'EMPOWERED_BY' and src in (select unit from units where doc_id % 2 = 0) and dst in (select unit from units where doc_id % 2 = 0))")
def clear_edges(spark, sf):
    scope = units(spark, sf).where("doc_id % 2 = 0").select("unit")
    return writes.clear_derived(edges(spark, sf), ["EMPOWERED_BY"], scope).select("src", "dst", "rel")


@query(f"with {UNITS}, {EDGES} select src, dst, rel, case when src % 2 = 0 then 'new' else 'old' end as props from edges")
def merge_graph(spark, sf):
    e = edges(spark, sf)
    return writes.merge_edges(e.withColumn("props", F.lit("old")), e.where("src % 2 = 0").withColumn("props", F.lit("new")))


@query("select md5(text) as key, min(doc_id) as doc_id from documents where md5(text) not in (select md5(text) from documents where doc_id % 5 = 0) group by 1")
def cache_missing(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id")
    first = d.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return writes.missing(first, d.where("doc_id % 5 = 0"), "key")


@query("select text_md5, n from (select md5(text) as text_md5, count(*) as n from documents group by 1) where n > 1")
def uniqueness_violations(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"))
    return writes.assert_unique(d, "text_md5")


# Metrics: truth is which documents hold the passage; results come from the lexical search.
_TRUTH = "truth as (select item_id as query_id, doc_id as item from benchmark b join documents d on contains(d.text, b.text))"
_RES = f"{PASS}, {bm25_sql('documents', 'passages')}, {top_sql('scores', 'res0', 'doc_id', 20)}, res as (select query_id, doc_id as item, rank from res0)"
_METRIC = """ks as (select unnest([5, 10, 15, 20]) as k), qs as (select query_id from res union select query_id from truth), tn as (select query_id, count(*) as t from truth group by 1),
m as (select q.query_id, k, t, count(tr.item) as rel, min(r.rank) filter (where tr.item is not null) as first from qs q cross join ks left join tn using (query_id) left join res r on r.query_id = q.query_id and r.rank <= k left join truth tr on tr.query_id = r.query_id and tr.item = r.item group by all),
metrics as (select query_id, k, round(case when t is null then 1.0::double else rel / k end, 4) as precision, round(case when t is null then 1.0::double else least(1.0::double, rel / least(k, t)) end, 4) as adjusted_precision,
round(case when t is null then 1.0::double else rel / t end, 4) as recall, (case when t is null or rel > 0 then 1.0 else 0.0 end)::double as hit, round(case when t is null then 1.0::double else coalesce(1.0::double / first, 0.0::double) end, 4) as mrr from m)"""


def _truth(spark, sf):
    b = passages(spark, sf)
    titles = b.select(F.col("query_id").alias("doc_id"), F.col("text").alias("title"))
    found = graph.link_titles(table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text"), titles, stored)
    return stored(found.select(F.col("doc_id").alias("query_id"), F.col("case_id").alias("item")), "truth")  # metrics read it again and again


def _results(spark, sf):
    return stored(_lexical_top(spark, sf, 20).select("query_id", F.col("doc_id").alias("item"), "rank"), "results")


@query(f"with {_TRUTH}, {_RES}, {_METRIC} select * from metrics")
def ir_metrics_at_k(spark, sf):
    return metrics.at_cutoffs(_results(spark, sf), _truth(spark, sf), [5, 10, 15, 20])


@query(f"with {_TRUTH}, {_RES}, {_METRIC} select k, count(*) as n, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(hit), 4) as hit, round(avg(mrr), 4) as mrr from metrics where query_id in (select query_id from truth) group by 1")
def metric_means(spark, sf):
    """Means over the queries that have targets; those without are left out."""
    truth = _truth(spark, sf)
    m = metrics.at_cutoffs(_results(spark, sf), truth, [5, 10, 15, 20]).join(truth.select("query_id").distinct(), "query_id", "left_semi")
    return m.groupBy("k").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "hit", "mrr")))


_SETS = "s as (select o_orderkey, list_distinct(list(l_partkey % 50)) as said, list_distinct(list(l_suppkey % 50) filter (where l_linenumber <= 3)) as truth from orders join lineitem on l_orderkey = o_orderkey group by 1)"


@query(
    f"""with {_SETS}, c as (select *, len(list_intersect(said, coalesce(truth, []))) as n_both, len(coalesce(truth, [])) as nt, len(said) as ns from s),
    p as (select o_orderkey, case when nt = 0 then 1.0::double when ns = 0 then 0.0::double else n_both / ns end as p, case when nt = 0 then 1.0::double else n_both / nt end as r from c)
    select o_orderkey, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end, 4) as f1 from p"""
)
def citation_f1(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    sets = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 50).alias("said"), F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey") % 50)).alias("truth"))
    return sets.select("o_orderkey", *(c.alias(k) for k, c in metrics.citation_scores(F.col("truth"), F.col("said")).items()))


@query("select event_type, user_id % 4 as slot, count(*) as n, round(avg(value), 4) as mean_value, grouping(event_type) + grouping(user_id % 4) as level from events group by grouping sets ((event_type, user_id % 4), (event_type), ())")
def grouping_set_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("slot", F.col("user_id") % 4)
    return e.groupingSets([["event_type", "slot"], ["event_type"], []], "event_type", "slot").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), (F.grouping("event_type").cast("long") + F.grouping("slot")).alias("level"))


@query("select event_type, count(*) as n, round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, max(value) as max from events group by 1")
def latency_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"), F.max("value").alias("max")
    )


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as n from events) where n = 1")
def best_score_merge(spark, sf):
    return retrieval.best_of(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("with s as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey, l_suppkey) as a, list(l_suppkey order by l_linenumber, l_partkey, l_suppkey) filter (where l_linenumber < 4 or l_orderkey % 2 = 0) as b from lineitem group by 1) select l_orderkey, a[i] as doc, b[i] as section from s, unnest(range(1, len(a) + 1)) t(i) where len(a) = len(b) union all select l_orderkey, unnest(a), x from s, unnest(b) u(x) where len(a) <> len(b)")
def expected_pair_expand(spark, sf):
    one = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(one.alias("l"))
    few = F.filter("l", lambda x: (x["l_linenumber"] < 4) | (F.col("l_orderkey") % 2 == 0))
    g = g.select("l_orderkey", F.transform("l", lambda x: x["l_partkey"]).alias("a"), F.transform(few, lambda x: x["l_suppkey"]).alias("b"))
    return metrics.expand_pairs(g, "a", "b").select("l_orderkey", "doc", "section")


@query(f"with {UNITS} select doc_id, unit, last_value(case when page > 25 then cited end ignore nulls) over (partition by doc_id order by unit rows unbounded preceding) as ref from units")
def inherit_last_ref(spark, sf):
    d = units(spark, sf).select("doc_id", "unit", F.when(F.col("page") > 25, F.col("cited")).alias("own"))
    return metrics.inherit_last(d, ["doc_id"], "unit", "own", "ref").drop("own")


@query("with q as (select l_orderkey as law, l_linenumber as part, case when l_quantity < 10 then null else l_returnflag || l_linestatus end as quote from lineitem where l_linenumber <= 2), w as (select l_orderkey as law, l_linenumber as part, l_linestatus as reason from lineitem where l_linenumber >= 2 and l_linenumber <= 3) select law, part, quote, reason from q full join w using (law, part)")
def response_merge(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("part"), "l_quantity", "l_returnflag", "l_linestatus")  # noqa: E741
    q = l.where("part <= 2").select("law", "part", F.when(F.col("l_quantity") < 10, "-").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("quote"))
    w = l.where("part between 2 and 3").select("law", "part", F.col("l_linestatus").alias("reason"))
    return audit.merge_by_law(q, w, ["law", "part"])


@query(f"with {FAQ} select case_id, question, answer from faq")
def faq_pairs(spark, sf):
    return faq(spark, sf).select("case_id", "question", "answer")


@query("select quality, toxic, lang, count(*) as n from documents join labels using (doc_id) where toxic = 0 group by all")
def quality_gate(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 0"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, count(*) filter (where event_type = 'error') as n_errors from events group by all")
def audit_log_daily(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("select user_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute then 1 else 0 end as new from events)) group by user_id, sid")
def event_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prev = F.lag("ts").over(w)
    e = table(spark, sf, "events").withColumn("new", F.when(prev.isNull() | (F.col("ts") - prev > F.expr("interval 30 minutes")), 1).otherwise(0))
    e = e.withColumn("sid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "sid").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("sid")
