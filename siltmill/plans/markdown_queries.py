"""Parsers, chunkers and citations over markdown that is made from the driver's rows, so that SQL knows the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, graph, matching
from ..operators.chunking import chunk_documents
from ..operators.corpus import page_paragraphs
from ..sources.markdown import parse_documents
from ..sources.snapshots import Catalog
from .corpus_queries import _ORDERED, ordered_lines
from .tables import query, scratch, stored, table

_N = "cast(n as varchar)"


def _files(spark, sf, before, line, after="", glue="\n", quantity=False):
    """path, title, text: a file for each order, of one part for each line."""
    rows = ordered_lines(spark, sf, quantity)
    parts = F.array_join(F.transform("l", line), glue)
    return rows.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.concat(before if not isinstance(before, str) else F.lit(before), parts, F.lit(after)).alias("text"))


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _mark(x):
    return _say("<!-- Page ", x["n"], " of ", F.size("l"), " -->\n")


def _blocks(df):
    return parse_documents(df).select(F.col("doc").cast("long").alias("doc_id"), F.col("ord").cast("long"), "type", "level", "text", F.col("page_start").cast("long"), F.col("page_end").cast("long"), F.col("n_rows").cast("long"))


@query(
    f"""with {_ORDERED}, b as (select l_orderkey as doc_id, n, 0 as k, 'ราชกิจจา เล่ม ' || n as text from l where n = 1 or pages < 4 union all select l_orderkey, n, 1, 'line ' || word || ' (' || chr(cast(96 + n as int)) || ')' from l)
    select doc_id, row_number() over (partition by doc_id order by n, k) - 1 as ord, 'paragraph' as type, 0 as level, text, n as page_start, n as page_end, null::bigint as n_rows from b"""
)
def page_blocks(spark, sf):
    """Pages and their paragraphs; from four pages on, a running header stays on the first one only."""
    body = lambda x: F.concat(_mark(x), _say("ราชกิจจา เล่ม ", x["n"], "\n\nline ", x["word"], " ("), F.char((96 + x["n"]).cast("int")), F.lit(")\n"))
    return _blocks(_files(spark, sf, "", body))


_PIPE = "'| Part | Qty |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || word || ' | ' || cast(l_quantity as int) || ' |', chr(10) order by n)"
_QTY = _ORDERED.replace("l_orderkey, row_number()", "l_orderkey, l_quantity, l_returnflag, row_number()")


@query(f"with {_QTY} select l_orderkey as doc_id, {_PIPE} as text, count(*) as n_rows from l group by 1")
def pipe_tables(spark, sf):
    row = lambda x: _say("| ", x["word"], " | ", x["qty"], " |")
    return _blocks(_files(spark, sf, "| Part | Qty |\n|:--|--:|\n", row, quantity=True)).where("type = 'table'").select("doc_id", "text", "n_rows")


@query(f"with {_QTY} select l_orderkey as doc_id, {_PIPE} as text, count(*) as n_rows, 1 as page_start, count(*) as page_end from l group by 1")
def split_tables(spark, sf):
    """A table that goes on over page breaks, its header on each page, is one table."""
    page = lambda x: F.concat(_mark(x), _say("| Part | Qty |\n|--|--|\n| ", x["word"], " | ", x["qty"], " |\n"))
    return _blocks(_files(spark, sf, "", page, quantity=True)).where("type = 'table'").select("doc_id", "text", "n_rows", "page_start", "page_end")


@query(
    f"""with {_QTY}, t as (select *, first_value(word) over (partition by l_orderkey order by n) as top from l)
    select l_orderkey as doc_id, '| Order / First | Order / Part & more |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || top || ' | ' || word || ' ' || cast(l_quantity as int) || ' |', chr(10) order by n) as text, count(*) as n_rows from t group by 1"""
)
def html_tables(spark, sf):
    """Spans, a header of two levels, entities and line breaks of an HTML table; text before it stays a paragraph."""
    head = F.concat(F.lit("before <table><tr><th colspan=2>Order</th></tr><tr><th>First</th><th>Part &amp; more</th></tr>"))
    row = lambda x: F.concat(F.lit("<tr>"), F.when(x["n"] == 1, _say("<td rowspan=", F.size("l"), ">", x["word"], "</td>")).otherwise(""), _say("<td><b>", x["word"], "</b><br/>", x["qty"], "</td></tr>"))
    t = parse_documents(_files(spark, sf, head, row, "</table>", "\n", True), columns=["doc", "text", "n_rows"], types=["table"])
    return t.select(F.col("doc").cast("long").alias("doc_id"), "text", F.col("n_rows").cast("long"))


@query(f"with {_ORDERED}, b as (select l_orderkey as doc_id, n, unnest([0, 1, 2]) as k, word from l) select doc_id, (n - 1) * 3 + k as ord, case k when 2 then 'paragraph' else 'heading' end as type, case k when 0 then 1 when 1 then 2 else 0 end as level, case k when 0 then 'part ' || word || ' goes on' when 1 then 'sub ' || word else '12345 %% ' || n end as text from b")
def heading_blocks(spark, sf):
    """A heading that wraps is one; a rule ends a paragraph; a line of signs is no heading."""
    body = lambda x: F.concat(_say("# part ", x["word"], "\n# goes on\n## **sub ", x["word"], "**\n# 12345 %% ", x["n"]), F.lit("\n---\n"))
    return _blocks(_files(spark, sf, "", body)).select("doc_id", "ord", "type", "level", "text")


_THAI = "translate(cast(n as varchar), '0123456789', '๐๑๒๓๔๕๖๗๘๙')"
_CHUNK = ["doc_id", "ord", "doc_type", "kind", "label", "content", "path"]


def _chunks(df, *columns):
    """The named columns, of _CHUNK if none; path is the section path joined, doc_id the file's."""
    wanted = columns or _CHUNK
    own = {"doc_id": ("source_file", F.col("source_file").cast("long")), "ord": ("ord", F.col("ord").cast("long")), "path": ("section_path", F.array_join("section_path", "/"))}
    taken = list(dict.fromkeys(own[c][0] if c in own else c for c in wanted))
    return chunk_documents(df, columns=taken).select(*(own[c][1].alias(c) if c in own else c for c in wanted))


@query(
    f"""with {_ORDERED}, c as (select l_orderkey as doc_id, 0 as n, 'preamble' as kind, 'บทนำ' as label, 'คำปรารภ' as content, '' as path from l where n = 1 and pages > 1
    union all select l_orderkey, n, 'statute_unit', 'มาตรา ' || {_THAI}, 'มาตรา ' || {_THAI} || ' เนื้อหา ' || word, 'หมวด ๑ ' || first_value(word) over (partition by l_orderkey order by n) from l where pages > 1)
    select doc_id, n as ord, 'statute' as doc_type, kind, label, content, path, 'Doc ' || doc_id || ' | ' || label as entry, 'chunk_' || substr(md5('Doc ' || doc_id || ' | ' || label), 1, 16) as chunk_id from c"""
)
def statute_units(spark, sf):
    """A provision a chunk, the chapter its path, what comes before the preamble; a number out of sequence is text."""
    head = F.concat(F.lit("คำปรารภ\n# หมวด ๑ "), F.get("l", F.lit(0))["word"], F.lit("\n"))
    unit = lambda x: F.concat(_say("มาตรา "), T.to_thai(x["n"].cast("string")), _say(" เนื้อหา ", x["word"]))
    return _chunks(_files(spark, sf, head, unit), *_CHUNK, "entry", "chunk_id").where("doc_type = 'statute'")


@query(
    f"""with {_ORDERED} select l_orderkey as doc_id, n - 1 as ord, 'general' as doc_type, 'section' as kind, case when pages = 1 then 'ทั้งฉบับ' else 'หัวข้อ ' || word || ' ' || chr(cast(96 + n as int)) end as label,
    '## หัวข้อ ' || word || ' ' || chr(cast(96 + n as int)) || chr(10) || chr(10) || rtrim(repeat(word || ' ', 40)) as content, 'หัวข้อ ' || word || ' ' || chr(cast(96 + n as int)) as path from l"""
)
def general_sections(spark, sf):
    body = lambda x: F.concat(_say("# หัวข้อ ", x["word"], " "), F.char((96 + x["n"]).cast("int")), F.lit("\n\n"), F.repeat(F.concat(x["word"], F.lit(" ")), F.lit(40)), F.lit("\n"))
    return _chunks(_files(spark, sf, "", body)).select(*_CHUNK)


# A section below 300 characters (those of its paragraphs and its title, without blank lines) takes the next one in while both have at most 1,500.
_JOINS = "g.size < 300 and g.size + s.size <= 1500"


@query(
    f"""with recursive {_ORDERED}, s as (select l_orderkey as doc_id, n, 's ' || word || ' ' || chr(cast(96 + n as int)) as path, length('## ' || path) + length('short') as size from l),
    g as (select doc_id, n, 0::bigint as ord, size from s where n = 1 union all select s.doc_id, s.n, case when {_JOINS} then g.ord else g.ord + 1 end, case when {_JOINS} then g.size + s.size else s.size end from g join s on s.doc_id = g.doc_id and s.n = g.n + 1)
    select doc_id, ord, 'general' as doc_type, 'section' as kind, case when count(*) over (partition by doc_id) = 1 then 'ทั้งฉบับ' else min_by(path, n) end as label,
    string_agg('## ' || path || chr(10) || chr(10) || 'short', chr(10) || chr(10) order by n) as content, min_by(path, n) as path from g join s using (doc_id, n) group by doc_id, ord"""
)
def held_sections(spark, sf):
    """Sections too short to stand alone join the next one; the first one's path and label stay. What has grown long enough is a chunk, and the next section starts anew."""
    body = lambda x: F.concat(_say("# s ", x["word"], " "), F.char((96 + x["n"]).cast("int")), F.lit("\nshort\n"))
    return _chunks(_files(spark, sf, "", body)).select(*_CHUNK)


@query(
    f"""with {_ORDERED}, q as (select l_orderkey as doc_id, n, n - 1 as ord, 'question ' || word || ' more' as question, 'answer ' || word || ' so' as answer, pages from l)
    select doc_id, ord, 'faq' as doc_type, 'faq' as kind, case when pages = 1 then 'ทั้งฉบับ' else 'ทั่วไป ข้อ ' || n end as label, 'คำถาม: ' || question || chr(10) || 'คำตอบ: ' || answer as content, 'ทั่วไป' as path from q"""
)
def faq_chunks(spark, sf):
    """Question rows that go on in the next row, under a category row."""
    row = lambda x: _say("| ", x["n"], " | question ", x["word"], " | answer ", x["word"], " |\n| | more | so |")
    return _chunks(_files(spark, sf, "| ที่ | คำถาม | คำตอบ |\n|--|--|--|\n| ทั่วไป | | |\n", row)).select(*_CHUNK)


@query(
    f"""with {_ORDERED}, p as (select l_orderkey as doc_id, n, pages, unnest([1, 2, 3]) as part, word from l), c as (select doc_id, (n - 1) * 3 + part - 1 as ord, n, part, 'มาตรา ' || {_THAI} || ' (ตอนที่ ' || part || ')' as label, case part when 1 then 'มาตรา ' || {_THAI} || ' ' || repeat(word || 'x', 150) when 2 then repeat(word || 'y', 160) else repeat(word || 'z', 155) end as content from p where pages > 1)
    select doc_id, ord, label, content, dense_rank() over (partition by doc_id order by n) as parent from c"""
)
def long_units(spark, sf):
    """A provision too long for one chunk is cut at its lines into parts with one parent."""
    unit = lambda x: F.concat(_say("มาตรา "), T.to_thai(x["n"].cast("string")), F.lit(" "), F.repeat(F.concat(x["word"], F.lit("x")), F.lit(150)), F.lit("\n"), F.repeat(F.concat(x["word"], F.lit("y")), F.lit(160)), F.lit("\n"), F.repeat(F.concat(x["word"], F.lit("z")), F.lit(155)))
    c = _chunks(_files(spark, sf, "", unit), "doc_id", "ord", "label", "content", "parent", "doc_type").where("doc_type = 'statute'")
    return c.select("doc_id", "ord", "label", "content", F.col("parent").cast("long"))


@query(f"with {_ORDERED} select l_orderkey as doc_id, count(*) as n_rows, true as headed from l group by 1")
def long_tables(spark, sf):
    """A long table is cut into row groups, its header in each; no row is lost or repeated."""
    row = lambda x: F.concat(_say("| ", x["n"], " | "), F.repeat(x["word"], F.lit(60)), F.lit(" |"))
    c = _chunks(_files(spark, sf, "intro\n\n| No | Text |\n|--|--|\n", row), "doc_id", "kind", "content").where("kind = 'table'")
    headed = F.contains("content", F.lit("| No | Text |\n|---|---|\n")) & (F.length("content") <= 2000 + 260)
    return c.groupBy("doc_id").agg((F.sum(F.size(F.split("content", "\n", -1)) - 4)).alias("n_rows"), F.bool_and(headed).alias("headed"))


@query("select o_orderkey, 'มาตรา' as kind, o_custkey as number, o_orderkey % 4 + 1 as part, 'มาตรา ' || o_custkey as base, 2500 + o_orderkey % 90 as year_be, o_orderkey % 12 as chapter, 'ข้อ ' || o_custkey || ',มาตรา ' || o_orderkey as cited from orders")
def unit_labels(spark, sf):
    """Unit labels, years, chapters and cited units, from Thai digits."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    thai = lambda *p: T.to_thai(_say(*p))
    o = table(spark, sf, "orders").select(
        k,
        F.concat(thai("มาตรา ", c, " (ตอนที่ ", k % 4 + 1, ")")).alias("label"),
        thai("ประกาศ พ.ศ. ", 2500 + k % 90).alias("year"),
        F.array(F.lit("บท"), thai("หมวด ", k % 12, " ทั่วไป")).alias("path"),
        thai("ข้อ  ", c, " และมาตรา ", k, " กับ ข้อ ", c).alias("text"),
    )
    u = T.unit_ref(F.col("label"))
    return o.select(k, u["kind"].alias("kind"), u["number"].cast("long").alias("number"), u["part"].cast("long").alias("part"), u["base"].alias("base"), T.year_be(F.col("year")).cast("long").alias("year_be"), T.chapter_number(F.col("path")).cast("long").alias("chapter"), F.array_join(T.cited_units(F.col("text")), ",").alias("cited"))


_ACT_UNITS = "u as (select o_orderkey as id, o_orderkey as num, o_custkey as cites from orders)"


def _act_units(spark, sf):
    o = table(spark, sf, "orders")
    other = F.when(F.col("o_orderkey") % 5 == 0, " แห่งประมวลรัษฎากร").otherwise(" และต่อไป")
    text = F.concat(_say("ให้นำมาตรา ", F.col("o_custkey")), other, _say(" หรือมาตรา ", F.col("o_orderkey"), " มาใช้"))
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.lit(citations.ACT).alias("doc"), T.to_thai(_say("มาตรา ", F.col("o_orderkey"))).alias("label"), T.to_thai(text).alias("text"))


_ACT_EDGES = f"""with {_ACT_UNITS} select a.id as src, b.id as dst, 'CITES' as rel from u a join u b on b.num = a.cites where a.id <> b.id and a.id % 5 <> 0
    union all select id, n2, 'NEXT_SECTION' from (select id, lead(id) over (order by num) as n2, num, lead(num) over (order by num) as nn from u) where nn = num + 1 and num <> 0"""


@query(_ACT_EDGES)
def citation_edges(spark, sf):
    """Citations in the text of an act's sections: none of another law, none of itself; and the reading order."""
    return citations.legal_edges(_act_units(spark, sf)).select(F.col("src").cast("long"), F.col("dst").cast("long"), "rel")


@query(_ACT_EDGES)
def citation_edges_lateral(spark, sf):
    """The same edges from mentions that SQL lists with a lateral table function."""
    return citations.legal_edges(_act_units(spark, sf), find=citations.lateral_mentions).select(F.col("src").cast("long"), F.col("dst").cast("long"), "rel")


@query("select o_orderkey, ord, kind, num, case ord when 0 then 11 else 24 + length(o_custkey::varchar) end as start, 6 + length(num::varchar) - case ord when 0 then 0 else 3 end as length from (select o_orderkey, o_custkey, 0 as ord, 'section' as kind, o_custkey as num from orders union all select o_orderkey, o_custkey, 1, 'clause', o_orderkey from orders)")
def mention_offsets(spark, sf):
    """Where each unit is named in the text as it is, Thai digits and bracketed marks included."""
    text = F.concat(F.lit("[มาตรา ๙] ก"), T.to_thai(_say("มาตรา ", F.col("o_custkey"))), F.lit(" และต่อ"), T.to_thai(_say("ข้อ", F.col("o_orderkey"))))
    rows = citations.lateral_mentions(table(spark, sf, "orders").select("o_orderkey", text.alias("text")))
    return rows.select("o_orderkey", F.col("ord").cast("long"), "kind", F.col("num").cast("long"), F.col("start").cast("long"), F.col("length").cast("long"))


@query("select c_custkey, 'section' as kind, c_nationkey + 1 as num from customer where c_custkey % 3 <> 0 union all select c_custkey, 'clause', c_custkey from customer where c_custkey % 2 = 0")
def tenant_references(spark, sf):
    """Statutes that a tenant's text names: clauses only after the regulation's name, sections unless of another law."""
    k = F.col("c_custkey")
    section = F.concat(_say("ตามมาตรา ", F.col("c_nationkey") + 1), F.when(k % 3 == 0, " แห่งประมวลรัษฎากร").otherwise(" ของงาน"))
    clause = F.concat(F.when(k % 2 == 0, " ระเบียบกระทรวงการคลัง").otherwise(" งานตาม"), _say(" ข้อ ", k))
    chunks = table(spark, sf, "customer").select(k.cast("string").alias("chunk_id"), T.to_thai(F.concat(section, F.lit(" " * 5), clause)).alias("text"))
    return citations.tenant_references(chunks).select(F.col("chunk_id").cast("long").alias("c_custkey"), "kind", F.col("num").cast("long"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 3 = 0 or (l_partkey % 3 = 1 and l_suppkey % 2 = 0)) as hit, l_suppkey % 2 = 0 as by_text from lineitem")
def relevance_match(spark, sf):
    """A labelled chunk matches by document and unit (or the whole document), an unlabelled one by its text."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    path, section = _say("laws/Big Act ", F.col("l_orderkey"), ".md"), T.to_thai(_say("มาตรา ", n))
    label = F.when(p % 3 == 0, "ทั้งฉบับ").otherwise(_say("มาตรา ", n + s % 2 * 10))
    entry = F.concat(F.when(p % 3 == 2, "Other Act ").otherwise("Big Act "), _say(F.col("l_orderkey"), " | "), label)
    body = _say("see ม. ", n + s % 2 * 10, " there")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", matching.chunk_matches(path, section, entry, F.lit("")).alias("hit"), matching.chunk_matches(F.lit(""), section, F.lit("loose"), body).alias("by_text"))


@query(f"with {_ORDERED} select l_orderkey as doc_id, n - 1 as pos, repeat(word, 60) || chr(10) || chr(10) || repeat(word, 30) as chunk from l")
def page_paragraph_chunks(spark, sf):
    """The baseline chunker: paragraphs of a page joined while they fit."""
    body = lambda x: F.concat(_mark(x), F.repeat(x["word"], F.lit(60)), F.lit("\n \n"), F.repeat(x["word"], F.lit(30)), F.lit("\n"))
    files = _files(spark, sf, "", body)
    cut = F.pandas_udf(lambda s: s.map(page_paragraphs), "array<string>")
    return files.select(F.col("path").cast("long").alias("doc_id"), F.posexplode(cut("text")).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long"), "chunk")


@query(
    f"""with {_ACT_UNITS}, c as (select c_custkey as case_id, c_nationkey + 1 as a, c_custkey as b from customer), h as (select case_id, a as num, 0 as o from c union all select case_id, b, 1 from c where b % 4 <> 0),
    r as (select case_id, u.id as dst, min(o) as o from h join u using (num) group by all) select case_id, dst, row_number() over (partition by case_id order by o) as ord from r"""
)
def case_citations(spark, sf):
    """Sections that FAQ cases name, in order of mention, none of another law."""
    c = table(spark, sf, "customer")
    other = F.when(F.col("c_custkey") % 4 == 0, " แห่งประมวลรัษฎากร").otherwise(" ด้วย")
    cases = c.select(F.col("c_custkey").alias("case_id"), T.to_thai(F.concat(_say("ตามมาตรา ", F.col("c_nationkey") + 1, " ซึ่งกำหนดไว้และต่อมาได้แก้ไข กับมาตรา ", F.col("c_custkey")), other)).alias("text"), F.array().cast("array<string>").alias("cited_docs"))
    units = table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.lit(citations.ACT).alias("doc"), _say("มาตรา ", F.col("o_orderkey")).alias("label"), F.lit("").alias("text"))
    return citations.case_citations(cases, units).select("case_id", F.col("dst").cast("long"), F.col("ord").cast("long"))


@query("select c_custkey, c_nationkey + 1 as num, (select count(*) from orders where o_orderkey = c_nationkey + 1) * 2 as n_units, case when c_nationkey + 1 in (select o_orderkey from orders) then lpad(cast(c_nationkey + 1 as varchar), 12, '0') || 'a' end as first_unit from customer")
def resolved_references(spark, sf):
    """References to the units they name, all parts in order; those of no unit have none."""
    refs = table(spark, sf, "customer").select("c_custkey", F.lit(citations.ACT).alias("title"), F.lit("section").alias("kind"), (F.col("c_nationkey") + 1).cast("int").alias("num"))
    o = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("part"))
    units = o.select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "part").alias("id"), F.lit(citations.ACT).alias("doc"), _say("มาตรา ", F.col("o_orderkey"), " (ตอนที่ ", F.when(F.col("part") == "a", 1).otherwise(2), ")").alias("label"), F.lit("").alias("text"))
    got = citations.resolve_references(refs, units)
    return got.select("c_custkey", F.col("num").cast("long"), F.size("unit_ids").cast("long").alias("n_units"), F.get("unit_ids", F.lit(0)).alias("first_unit"))


@query(
    f"""with {_ACT_UNITS}, c as (select c_custkey as case_id, c_nationkey as n from customer)
    select distinct case_id, cast(n_nationkey as varchar) as dst, 'RELATES_TO_LAW' as rel from c join nation on contains('by Law ' || n || ' then', 'Law ' || n_nationkey) union all select case_id, cast(u.id as varchar), 'CITES' from c join u on u.num = n + 1"""
)
def faq_links(spark, sf):
    """What FAQ cases relate to by title and cite by number."""
    n = F.col("c_nationkey")
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), _say("by Law ", n, " then มาตรา ", n + 1).alias("text"), F.array().cast("array<string>").alias("cited_docs"))
    laws = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), _say("Law ", F.col("n_nationkey")).alias("title"))
    units = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit(citations.ACT).alias("doc"), _say("มาตรา ", F.col("o_orderkey")).alias("label"), F.lit("").alias("text"))
    return graph.faq_links(graph.link_titles(cases, laws, stored), citations.case_citations(cases, units))


_NOW = "(l_orderkey % 5 <> 1)"
_CHANGED = "case when l_orderkey % 3 <> 0 and l_orderkey % 7 = 2 then word || 'q' else word end"


@query(
    f"""with {_ORDERED} select l_orderkey as doc_id, case when pages = 1 then 'ทั้งฉบับ' else 'หัวข้อ ' || word || ' ' || chr(cast(96 + n as int)) end as label,
    '## หัวข้อ ' || word || ' ' || chr(cast(96 + n as int)) || chr(10) || chr(10) || repeat({_CHANGED} || ' ', 40) || l_orderkey as content,
    case when l_orderkey % 3 = 0 then 'added' when l_orderkey % 7 = 2 then 'changed' else 'kept' end as state, count(distinct l_orderkey) over (partition by case when l_orderkey % 3 = 0 then 'added' when l_orderkey % 7 = 2 then 'changed' else 'kept' end) as n_files from l where {_NOW}"""
)
def incremental_build(spark, sf):
    """A corpus after an update by added, changed and removed files, with how many files the update took for each."""
    from ..engine import Engine

    def files(mark):
        body = lambda x: F.concat(_say("# หัวข้อ ", x["word"], " "), F.char((96 + x["n"]).cast("int")), F.lit("\n\n"), F.repeat(F.concat(x["word"], mark, F.lit(" ")), F.lit(40)), F.col("doc_id").cast("string"), F.lit("\n"))
        return _files(spark, sf, "", body)

    key = F.col("path").cast("long")
    engine = Engine(spark, Catalog(spark, scratch(spark, "corpus")))
    engine.build(files(F.lit("")).where(key % 3 != 0))
    changed = (F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 7 == 2)
    n = engine.update(files(F.when(changed, "q").otherwise("")).where(key % 5 != 1))
    doc = F.col("source_file").cast("long")
    state = F.when(doc % 3 == 0, "added").when(doc % 7 == 2, "changed").otherwise("kept")
    count = F.when(state == "added", n["added"]).when(state == "changed", n["changed"]).otherwise(n["kept"])
    return engine.catalog.read("chunks").select(doc.alias("doc_id"), "label", "content", state.alias("state"), count.cast("long").alias("n_files"))
