"""Tenancy, scalar functions and corpus building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..session import own_only, visible
from .tables import DOCS, LINES, docs, query, table, tok

@query(f"with {DOCS}, c as (select org_id, count(*) as n_own from docs group by 1), p as (select count(*) as n from docs where org_id = 'PUBLIC') select org_id, n_own, case when org_id = 'PUBLIC' then n_own else n_own + n end as n_visible from c, p")
def tenant_visible_counts(spark, sf):
    d = docs(spark, sf)
    public = d.where("org_id = 'PUBLIC'").agg(F.count("*").alias("n"))
    own = d.groupBy("org_id").agg(F.count("*").alias("n_own"))
    return own.crossJoin(F.broadcast(public)).select("org_id", "n_own", F.when(F.col("org_id") == "PUBLIC", F.col("n_own")).otherwise(F.col("n_own") + F.col("n")).alias("n_visible"))


@query(f"with {DOCS} select doc_id, org_id from docs where org_id = 'SRC5'")
def own_only_docs(spark, sf):
    return own_only(docs(spark, sf), "SRC5").select("doc_id", "org_id")


@query(f"with {DOCS} select distinct title from docs where org_id in ('PUBLIC', 'SRC4') order by 1")
def catalog_titles(spark, sf):
    return visible(docs(spark, sf), "SRC4").select("title").distinct().orderBy("title")


@query("select doc_id, md5(translate(text, '0123456789', '๐๑๒๓๔๕๖๗๘๙')) as thai_md5, true as round_trip from documents")
def digits_normalise(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.to_thai(F.col("text"))).alias("thai_md5"), (T.to_arabic(T.to_thai(F.col("text"))) == F.col("text")).alias("round_trip"))


@query(f"select doc_id, cast(len({tok('text')}) as bigint) as n_tokens, cast(len(list_distinct({tok('text')})) as bigint) as n_terms from documents")
def token_stats(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"select distinct term, cast(('0x' || substr(md5(term), 1, 8))::bigint % 1000000 + 1 as bigint) as idx from (select unnest({tok('text')}) as term from documents)")
def token_hash_index(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return d.select("term", T.token_index(F.col("term")).alias("idx"))


@query(f"with {LINES}, e as (select doc_id, ord, 'doc_' || doc_id || ' | line ' || ord as entry from lines) select doc_id, ord, entry, 'chunk_' || substr(md5(entry), 1, 16) as chunk_id from e")
def chunk_ids(spark, sf):
    e = T.entry(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.concat(F.lit("line "), F.col("ord").cast("string")))
    return C.lines(table(spark, sf, "documents")).select("doc_id", F.col("ord").cast("long"), e.alias("entry"), T.chunk_id(e).alias("chunk_id"))


@query("select p_partkey, substr(regexp_replace(p_name, '[^\\p{L}\\p{N}_]+', '_', 'g'), 1, 40) || '_' || substr(md5(p_name), 1, 8) as slug from part")
def slug_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug_id(F.col("p_name")).alias("slug"))


def evidence_sql(expr):
    """normal_evidence in SQL."""
    for name, char in T.ENTITIES[1:]:
        expr = f"replace({expr}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    tags = f"regexp_replace({expr}, '(?i)</?(?:{'|'.join(T.EVIDENCE_TAGS)})(?:\\s[^>]*)?/?>', ' ', 'g')"
    return f"lower(regexp_replace(translate({tags}, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[\\s|#*`\"''“”‘’]+', '', 'g'))"


_MARKED = "'<b>ก่า ก้า กา</b> | “' || doc_id || '” ๑๒ <x y> ' || text"


@query(f"select doc_id, md5({evidence_sql(_MARKED)}) as key from documents")
def normalise_text(spark, sf):
    """Thai vowel and tone marks, unknown tags and signs count; known tags, quotes, bars and spaces don't."""
    t = F.concat(F.lit("<b>ก่า ก้า กา</b> | “"), F.col("doc_id").cast("string"), F.lit("” ๑๒ <x y> "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normal_evidence(t)).alias("key"))


_PREFIX = ["พระราชบัญญัติ", "กฎกระทรวง", "ระเบียบ", "หนังสือเวียน"]


@query(f"with t as (select doc_id, {_PREFIX}[doc_id % 4 + 1] || ' ' || source as title from documents) select doc_id, case when starts_with(title, '{_PREFIX[0]}') then 'ACT' when starts_with(title, '{_PREFIX[1]}') then 'MINISTERIAL_RULE' when starts_with(title, '{_PREFIX[2]}') then 'REGULATION' else 'CIRCULAR' end as level from t")
def level_case(spark, sf):
    title = F.concat(F.get(F.array(*map(F.lit, _PREFIX)), (F.col("doc_id") % 4).cast("int")), F.lit(" "), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", T.legal_level(title).alias("level"))


@query("with v as (select c_custkey, unnest([c_name, replace(c_name, '#', ''), 'กรม_' || c_custkey, repeat('a', 65), '']) as org from customer) select c_custkey, org, regexp_matches(org, '^[A-Za-z0-9\\x{0E00}-\\x{0E7F}_-]{1,64}$') as ok from v")
def org_id_valid(spark, sf):
    names = F.array(F.col("c_name"), F.replace(F.col("c_name"), F.lit("#"), F.lit("")), F.concat(F.lit("กรม_"), F.col("c_custkey").cast("string")), F.lit("a" * 65), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", F.explode(names).alias("org")).withColumn("ok", T.valid_org(F.col("org")))


_CELL = "regexp_replace(cell, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _CELL = f"replace({_CELL}, '{_a}', '{_b}')"


@query(f"with c as (select page_id, unnest(range(0, len(l))) as pos, unnest(l) as cell from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) as l from pages)) select page_id, pos, trim(regexp_replace({_CELL}, '\\s+', ' ', 'g')) as cell from c")
def clean_cells(spark, sf):
    cells = F.regexp_extract_all("html", F.lit(r"<li>(.*?)</li>"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(cells).alias("pos", "cell")).select("page_id", F.col("pos").cast("long"), T.clean_cell(F.col("cell")).alias("cell"))


@query("with f as (select doc_id, printf('%09d', doc_id) || '.md' as path, text from documents) select path, case when path = min(path) over (partition by md5(text)) then null else min(path) over (partition by md5(text)) end as duplicate_of from f")
def dup_files(spark, sf):
    f = table(spark, sf, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")).alias("path"), "text")
    return C.drop_duplicate_files(f).select("path", "duplicate_of")


@query("with t as (select doc_id, lang || '  ' || source as raw from documents), k as (select doc_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as k from t), n as (select *, row_number() over (partition by k order by doc_id) as n from k) select doc_id, case when n = 1 then k else k || ' (' || n || ')' end as title from n")
def title_disambiguate(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit("  "), "source").alias("raw"))
    return C.disambiguate(t, "raw", ["doc_id"], "title").select("doc_id", "title")


@query("with e as (select doc_id, source || ' | ' || lang as entry from documents), n as (select *, row_number() over (partition by entry order by doc_id) as n, count(*) over (partition by entry) as c from e) select doc_id, case when c > 1 then entry || ' (ตอนที่ ' || n || ')' else entry end as unique_entry from n")
def label_dedupe(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", T.entry(F.col("source"), F.col("lang")).alias("entry"))
    return C.dedupe_labels(e, "entry", ["doc_id"], "unique_entry").select("doc_id", "unique_entry")


@query("select lang, source, count(*) as n from documents group by grouping sets ((lang), (source), (lang, source), ())")
def kind_histogram(spark, sf):
    return table(spark, sf, "documents").groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"))


_ORDERED = "l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, count(*) over (partition by l_orderkey) as pages, translate(cast((l_partkey + 10000) * 100000 + l_suppkey as varchar), '0123456789', 'abcdefghij') as word from lineitem)"


@query(f"with {_ORDERED} select l_orderkey as doc_id, n as ord, n as page_start, least(n + 1, pages) as page_end from l")
def page_offsets(spark, sf):
    """Chunks that run from one page into the next are found by their first and last characters, searched forward."""
    rows = ordered_lines(spark, sf)
    body = lambda x: F.concat(F.lit("line "), x["n"].cast("string"), F.lit(" says "), F.repeat(F.concat(x["word"], F.lit("-"), x["n"].cast("string"), F.lit(" ")), F.lit(12)))
    page = lambda x: F.concat(F.lit("<!-- Page "), x["n"].cast("string"), F.lit(" of "), F.size("l").cast("string"), F.lit(" -->\n"), body(x))
    files = rows.select("doc_id", F.array_join(F.transform("l", page), "\n").alias("text"))
    both = lambda x: F.concat(F.lit("[Doc | x]\n"), body(x), F.coalesce(F.concat(F.lit(" "), body(F.get(F.col("l"), x["n"].cast("int")))), F.lit("")))
    chunks = rows.select("doc_id", F.explode(F.transform("l", lambda x: F.struct(x["n"].alias("ord"), both(x).alias("text")))).alias("c")).select("doc_id", F.col("c.ord").alias("ord"), F.col("c.text").alias("text"))
    return C.locate_chunks(chunks, files).select("doc_id", "ord", F.col("page_start").cast("long"), F.col("page_end").cast("long"))


#: Lines that a task groups at most, on average; their sort stays in memory.
TASK_LINES = 250_000


def ordered_lines(spark, sf, quantity=False):
    """doc_id and l: an order's lines as structs (n from 1, word of letters, with quantity also qty) in order. Only keys are
    shuffled, and the quantity if it is asked for; words are made behind the shuffle."""
    fields = ["l_linenumber", "l_partkey", "l_suppkey", *(["qty"] if quantity else [])]
    lines = table(spark, sf, "lineitem").withColumn("qty", F.col("l_quantity").cast("int")).select(F.col("l_orderkey").alias("doc_id"), *fields)
    # lines are short and the texts made of them long, so a given number of partitions, which AQE does not merge by their bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-table(spark, sf, "lineitem").count() // TASK_LINES))
    g = lines.repartition(n, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_l"))
    word = lambda x: F.translate(((x["l_partkey"] + 10000) * 100000 + x["l_suppkey"]).cast("string"), "0123456789", "abcdefghij").alias("word")
    return g.select("doc_id", F.transform("_l", lambda x, i: F.struct((i + 1).cast("long").alias("n"), word(x), *(x[c].alias(c) for c in fields[3:]))).alias("l"))


@query("with s as (select doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) as s from documents where length(text) > 0) select doc_id, row_number() over (partition by doc_id order by s) - 1 as pos, md5(substr(text, s + 1, 1000)) as window_md5 from s where s = 0 or s + 200 < length(text)")
def fixed_overlap_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(C.overlapping_windows(F.col("text"))).alias("pos", "w"))
    return d.select("doc_id", F.col("pos").cast("long"), F.md5("w").alias("window_md5"))


@query(f"with recursive {LINES}, g as (select doc_id, 0::bigint as ord, 0::bigint as pack, length(content)::bigint as n from lines where ord = 0 union all select l.doc_id, l.ord, case when g.n + 2 + length(l.content) <= 1200 then g.pack else g.pack + 1 end, case when g.n + 2 + length(l.content) <= 1200 then g.n + 2 + length(l.content) else length(l.content) end from g join lines l on l.doc_id = g.doc_id and l.ord = g.ord + 1) select doc_id, pack, max(n) as pack_chars, count(*) as pieces from g group by all")
def greedy_pack(spark, sf):
    packs = C.greedy_pack(F.split("text", "\n", -1), 1200)
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(packs).alias("pack", "t"))
    return d.select("doc_id", F.col("pack").cast("long"), F.length("t").cast("long").alias("pack_chars"), F.size(F.split("t", "\n\n", -1)).cast("long").alias("pieces"))


_BLOCKS = f"{LINES}, b as (select doc_id, ord // 3 as page, ord, content from lines)"


@query(
    f"""with {_BLOCKS}, k as (select *, case when (row_number() over (partition by doc_id, page order by ord) <= 2 or row_number() over (partition by doc_id, page order by ord desc) = 1) and length(content) <= 150
    then regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '[0-9๐-๙]+', '#', 'g') end as key from b),
    p as (select doc_id, count(distinct page) as pages from b group by 1), f as (select doc_id, key, count(*) as freq, min(ord) as first from k where key is not null group by all)
    select k.doc_id, k.page, k.ord from k join p using (doc_id) left join f on f.doc_id = k.doc_id and f.key = k.key where not coalesce(pages >= 4 and freq >= greatest(3.0, 0.3 * pages) and ord <> first, false)"""
)
def running_headers(spark, sf):
    b = C.lines(table(spark, sf, "documents")).withColumns({"page": F.floor(F.col("ord") / 3), "ord": F.col("ord").cast("long")})
    return C.drop_running_headers(b).select("doc_id", "page", "ord")


@query("select lang, count(*) as n, round(avg(length(text)), 4) as mean_len, round(quantile_cont(length(text), 0.95), 4) as p95_len, max(length(text)) as max_len from documents group by 1")
def chunk_length_profile(spark, sf):
    return C.length_profile(table(spark, sf, "documents"), ["lang"], "text")


@query("select doc_id, case when n_chars is null then null when n_chars % 3 = 0 then cast(doc_id as varchar) || '/' || n_chars when n_chars % 3 = 1 then doc_id || '-' || (doc_id + 2) || '/' || n_chars else doc_id || '-' || (doc_id + 2) end as pages from documents")
def page_range_format(spark, sf):
    n, d = F.col("n_chars"), F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", T.page_range(F.when(n.isNotNull(), d), F.when(n % 3 == 0, d).otherwise(d + 2), F.when(n % 3 != 2, n)).alias("pages"))


@query("select o_orderkey, format('{:,}', cast(floor(o_totalprice) as bigint)) as price from orders")
def money_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.money(F.floor("o_totalprice")).alias("price"))


@query("select o_orderkey, year(o_orderdate) + 543 as year_be, case when year(o_orderdate) + 543 < 2538 then 0.0 else greatest(1.05, round(1.30 - 0.02 * ((select max(year(o_orderdate)) from orders) - year(o_orderdate)), 6)) end::double as boost from orders")
def recency_boosts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.year("o_orderdate") + 543).alias("year_be"))
    newest = F.broadcast(o.agg(F.max("year_be").alias("newest")))  # one row
    return o.crossJoin(newest).select("o_orderkey", F.col("year_be").cast("long"), F.round(T.recency_boost(F.col("year_be"), F.col("newest"), 2538), 6).alias("boost"))


_KINDS = ["แบบสัญญา จ้าง", "พระราชบัญญัติ", "ระเบียบกระทรวงการคลัง", "กฎกระทรวง", "ประกาศคณะกรรมการ", "คู่มือ"]
_TITLED = f"t as (select p_partkey, {_KINDS}[p_partkey % 6 + 1] as title, 'พ.ศ. ' || case p_partkey % 5 when 0 then 2535 when 1 then 2549 when 2 then 2560 when 3 then 2569 else 1999 end as entry, case when p_partkey % 7 = 0 then 'แบบฟอร์ม ปี 2561' else p_name end as text from part)"
_RANK = "case when regexp_matches(title || ' ' || entry || ' ' || left(text, 300), 'แบบสัญญา|แบบฟอร์ม|สัญญาสำเร็จรูป|ตัวอย่างสัญญา') then 0.75 when p_partkey % 6 < 5 then 1.25 else 1.0 end"


def _titled(spark, sf):
    k = F.col("p_partkey")
    year = F.when(k % 5 == 0, "2535").when(k % 5 == 1, "2549").when(k % 5 == 2, "2560").when(k % 5 == 3, "2569").otherwise("1999")
    return table(spark, sf, "part").select(
        k, F.get(F.array(*map(F.lit, _KINDS)), (k % 6).cast("int")).alias("title"), F.concat(F.lit("พ.ศ. "), year).alias("entry"), F.when(k % 7 == 0, "แบบฟอร์ม ปี 2561").otherwise(F.col("p_name")).alias("text")
    )


@query(f"with {_TITLED} select p_partkey, ({_RANK})::double as weight from t")
def hierarchy_weights(spark, sf):
    return _titled(spark, sf).select("p_partkey", T.hierarchy_multiplier(F.col("title"), F.col("entry"), F.col("text")).alias("weight"))


@query(
    f"""with {_TITLED}, y as (select *, case p_partkey % 5 when 0 then 2535 when 1 then 2549 when 2 then 2560 when 3 then 2569 else case when p_partkey % 7 = 0 then 2561 end end as year from t)
    select p_partkey, round(case when p_partkey % 5 = 0 or year < 2560 then 0.0 else ({_RANK}) * case when year is null then 1.0 else greatest(1.05, 1.30 - 0.02 * (2569 - year)) end end::double, 6) as boost from y"""
)
def source_boosts(spark, sf):
    """Rank times recency, from title, entry and text; the newest year comes from the candidates."""
    t = _titled(spark, sf)
    newest = F.broadcast(t.agg(T.newest_year(F.col("title"), F.col("entry")).alias("newest")))  # one row
    return t.crossJoin(newest).select("p_partkey", F.round(T.source_boost(F.col("title"), F.col("entry"), F.col("text"), F.col("newest")), 6).alias("boost"))


_ASKS = ["ค่าปรับ กี่บาท", "ผู้ชนะ ไม่ลงนาม", "MIT and TOR", "คัดเลือก คณะกรรมการ", "plain words"]
_ADDED = ["อัตราค่าปรับ การคิดค่าปรับ ค่าปรับรายวัน เกณฑ์ อัตรา หลักเกณฑ์ กำหนดไว้", "การทำสัญญา การลงนามในสัญญา การอุทธรณ์", "พัสดุที่ผลิตภายในประเทศ ส่งเสริมหรือสนับสนุน แต้มต่อ คุณลักษณะเฉพาะ การกำหนดคุณลักษณะเฉพาะ", "วิธีคัดเลือก หนังสือเชิญชวน คณะกรรมการซื้อหรือจ้าง การแต่งตั้งคณะกรรมการ ประธานกรรมการ", ""]


@query(f"select c_custkey, {_ASKS}[c_custkey % 5 + 1] || ' ' || c_custkey || case when c_custkey % 5 = 4 then '' else ' ' || {_ADDED}[c_custkey % 5 + 1] end as expanded from customer")
def query_expansion(spark, sf):
    k = F.col("c_custkey")
    ask = F.concat(F.get(F.array(*map(F.lit, _ASKS)), (k % 5).cast("int")), F.lit(" "), k.cast("string"))
    return table(spark, sf, "customer").select(k, T.expand_query(ask).alias("expanded"))


@query(f"select s.source, count(distinct s.doc_id) as n_docs, count(*) as n_rows, bool_and(len(s.text) > 0) as all_filled from documents s group by 1")
def store_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.bool_and(F.length("text") > 0).alias("all_filled"))


@query("select doc_id, title from (select doc_id, 'doc_' || doc_id || '_' || source as title from documents) where contains(lower(title), lower('C1')) or contains(lower(cast(doc_id as varchar)), lower('C1'))")
def like_filter(spark, sf):
    """Case-insensitive substring on title or id; the user's wildcards are literals."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), "source").alias("title"))
    pattern = F.concat(F.lit("%"), T.escape_like(F.lit("C1")), F.lit("%"))
    return d.where(F.ilike(F.col("title"), pattern) | F.ilike(F.col("doc_id").cast("string"), pattern))
