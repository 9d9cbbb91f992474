"""The driver's tables in the engine's terms, and the SQL that says the same for the oracle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.graph import next_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_INDEXES: dict[tuple, str] = {}


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is empty, on a local master only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _INDEXES.setdefault(("scratch", spark.sparkContext.applicationId), "file://" + tempfile.mkdtemp(prefix="siltmill-"))
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df as a written table below the scratch folder: later stages read it, and lost executors cost nothing."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lexical_index(df: DataFrame, name: str, key: str) -> retrieval.Index:
    """The saved index of df (key, text), built when it is first asked for in an application; files that change (names,
    lengths or times) get a new one."""
    spark = df.sparkSession
    hadoop, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    state = []
    for f in sorted(df.inputFiles()):
        status = at(f).getFileSystem(hadoop).getFileStatus(at(f))
        state.append((f, status.getLen(), status.getModificationTime()))
    known = (spark.sparkContext.applicationId, name, key, tuple(state))
    if known not in _INDEXES:
        folder = scratch(spark, f"index-{name}")
        retrieval.save_index(df, folder, key)
        _INDEXES[known] = folder
    return retrieval.open_index(spark, _INDEXES[known], key)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents with tenant and title: src0 to src2 are public, the other sources are tenants."""
    org = F.when(F.col("source").isin("src0", "src1", "src2"), "PUBLIC").otherwise(F.upper("source"))
    return table(spark, sf, "documents").withColumns({"org_id": org, "title": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))})


DOCS = "docs as (select *, case when source in ('src0', 'src1', 'src2') then 'PUBLIC' else upper(source) end as org_id, 'doc_' || doc_id as title from documents)"
LINES = "lines as (select doc_id, unnest(range(0, len(l))) as ord, unnest(l) as content from (select doc_id, string_split(text, chr(10)) as l from documents))"


def tok(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, variant_id, text: the whole passage and its first eight words."""
    p = passages(spark, sf)
    head = F.array_join(F.slice(F.split("text", " ", -1), 1, 8), " ")
    return p.select("query_id", F.lit(0).alias("variant_id"), "text").unionByName(p.select("query_id", F.lit(1).alias("variant_id"), head.alias("text")))


VARIANTS = "variants as (select item_id as query_id, 0 as variant_id, text from benchmark union all select item_id, 1, array_to_string(string_split(text, ' ')[1:8], ' ') from benchmark)"


def faq(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, question, answer, text: a user's turn and the assistant's turn after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    c = c.where("role = 'user' and next_role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("text").alias("question"), "answer", F.concat_ws(" ", "text", "answer").alias("text"))


FAQ = """turns as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as answer from conversations),
faq as (select conv_id * 1000 + turn as case_id, text as question, answer, concat_ws(' ', text, answer) as text from turns where role = 'user' and next_role = 'assistant')"""


def bm25_sql(doc_table: str, query_table: str, key: str = "doc_id", variant: str = "sparse", name: str = "scores", stats: str | None = None) -> str:
    """CTEs that end in `name` (query_id, key, score); stats: table for N, length and df when candidates are filtered."""
    s = stats or doc_table
    if variant == "sparse":
        idf = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
        part = "idf * round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)), 5)"
        idfs = f"{name}_i as (select term, {idf} as idf, avg_len from {name}_df, {name}_n)"
    else:
        raw = "ln((n_docs - df + 0.5) / (df + 0.5))"
        part = "qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len)))"
        idfs = f"{name}_r as (select term, {raw} as raw, avg_len from {name}_df, {name}_n), {name}_i as (select term, case when raw < 0 then 0.25 * (select avg(raw) from {name}_r) else raw end as idf, avg_len from {name}_r)"
    return f"""{name}_q as (select query_id, term, count(*) as qtf from (select query_id, unnest({tok('text')}) as term from {query_table}) group by all),
{name}_a as (select {key}, len(t) as doc_len, unnest(t) as term from (select {key}, {tok('text')} as t from {s})),
{name}_p as (select {key}, doc_len, term, count(*) as tf from {name}_a group by all),
{name}_n as (select count(*) as n_docs, avg(len({tok('text')})) as avg_len from {s}),
{name}_df as (select term, count(*) as df from {name}_p group by term),
{idfs},
{name} as (select query_id, {key}, round(sum({part}), 6) as score from {name}_p join {name}_q using (term) join {name}_i using (term) {f'where {key} in (select {key} from {doc_table})' if stats else ''} group by all)"""


COSINE = "round(list_dot_product({a}::double[], {b}::double[]) / (greatest(sqrt(list_dot_product({a}::double[], {a}::double[])), 1e-9) * greatest(sqrt(list_dot_product({b}::double[], {b}::double[])), 1e-9)), 6)"


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, q: the vector whose id is the passage's id stands in for the passage's embedding."""
    return passages(spark, sf).select("query_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")


QVEC = "qvec as (select item_id as query_id, embedding as q from benchmark join embeddings on vec_id = item_id)"
DENSE = f"dense as (select query_id, vec_id as doc_id, {COSINE.format(a='embedding', b='q')} as score from embeddings, qvec)"


def top_sql(src: str, name: str, key: str, k: int, rank: str = "rank") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, {key}) as {rank} from {src}) where {rank} <= {k})"


def rrf_sql(legs: list[str], name: str, key: str, k: int = 60) -> str:
    rows = " union all ".join(f"select query_id, {key}, 1.0::double / ({k} + rank) as part from {x}" for x in legs)
    return f"{name} as (select query_id, {key}, round(sum(part), 8) as score from ({rows}) group by all)"


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions: a line item is a unit of its order; its line number is the section number, its part what it cites.

    The id also holds part and supplier, because line numbers repeat within an order.
    """
    unit = (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("unit")
    level = F.when(F.col("l_returnflag") == "A", "ACT").when(F.col("l_returnflag") == "N", "REGULATION").otherwise("MINISTERIAL_RULE").alias("level")
    page = F.when(F.col("l_quantity") < 5, F.lit(None)).otherwise(F.col("l_quantity").cast("int")).alias("page")
    entry = F.concat_ws(" ", F.lit("order"), "l_orderkey", F.lit("| section"), "l_linenumber", F.lit("| part"), "l_partkey", "l_suppkey").alias("entry")
    return table(spark, sf, "lineitem").select(unit, F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("cited"), level, page, entry)


UNITS = """units as (select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as unit, l_orderkey as doc_id, l_linenumber as number, l_partkey as cited,
case l_returnflag when 'A' then 'ACT' when 'N' then 'REGULATION' else 'MINISTERIAL_RULE' end as level,
case when l_quantity < 5 then null else cast(l_quantity as int) end as page,
concat_ws(' ', 'order', l_orderkey, '| section', l_linenumber, '| part', l_partkey, l_suppkey) as entry from lineitem)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """CITES from a unit to the first unit of another order about the same part."""
    u = units(spark, sf)
    first = u.groupBy("cited").agg(F.min("unit").alias("dst"))
    return u.join(first, "cited").where("unit <> dst").select(F.col("unit").alias("src"), "dst", F.when(F.col("level") == "ACT", "CITES_CLAUSE").otherwise("EMPOWERED_BY").alias("rel"))


EDGES = "edges as (select unit as src, dst, case when level = 'ACT' then 'CITES_CLAUSE' else 'EMPOWERED_BY' end as rel from units join (select cited, min(unit) as dst from units group by cited) using (cited) where unit <> dst)"


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return next_edges(units(spark, sf), ["doc_id"], ["number", "unit"], "unit", "number")


NEXT = "nexts as (select unit as src, nu as dst from (select *, lead(unit) over w as nu, lead(number) over w as nn from units window w as (partition by doc_id order by number, unit)) where nn = number + 1 and number <> 0)"
