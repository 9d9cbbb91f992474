"""The queries of this subpackage, each over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_suffix_dedup, op02_packing, op03_chat, op04_sharding, op05_pii, op06_simhash, op07_decontamination, op08_token_counts, op09_language_id
from .common import documents
from .op10_media import media_columns
from .op11_periodic_runs import periodic_runs
from .op12_spelling_variants import spelling_variants, word_counts
from .op13_bestfit_packing import pack_best_fit

#: A key for queries and tests only; real runs pass their own.
DEMO_KEY = b"not a secret: demonstration key"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_suffix_dedup.remove_repeats(documents(spark, sf_dir), 400)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op02_packing.pack_pow2(documents(spark, sf_dir), 2048, 1)
    return packed.withColumn("ids_crc32", F.crc32("ids"))  # of the ids as they are emitted


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = op03_chat.read_back(op03_chat.format_chats(turns.unionByName(extra)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_sharding.shard_by_bytes(documents(spark, sf_dir), 24)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_simhash.near_duplicates(documents(spark, sf_dir), 3, 2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op07_decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("n_shared").cast("long"), F.col("n_shingles").cast("long"), F.round("containment", 6).alias("containment"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_token_counts.token_counts(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    profiles = op09_language_id.train(docs.select("text", "lang", held).where(~F.col("held_out")))
    return op09_language_id.identify(docs.select("doc_id", "text", held), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_columns(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height")


def planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents (by the crc32 h of doc_id) repeat words a to a+p-1 to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    some = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_w").cast("long"), F.floor(F.col("_h") / 10)
    a = F.when(n > 0, g % n)
    p = F.floor((n - F.col("_a")) / (3 + g % 8)) + 1
    placed = some.withColumn("_a", a.cast("int")).withColumn("_p", p.cast("int"))
    unit = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    rest = (n - F.col("_a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_period(documents(spark, sf_dir)))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = found.withColumn("_b", F.when(F.size("runs") > 0, best))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.start").alias("start"),
        (-F.col("_b.less")).alias("length"),
        F.col("_b.period").alias("period"),
        F.floor(-1000 * F.col("_b.less") / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(documents(spark, sf_dir), dropping=199)
    return spelling_variants(counts)


def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_best_fit(documents(spark, sf_dir), 1024, 2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_chat, op4_sharding, op5_pii, op6_simhash, op7_decontamination, op8_token_counts, op9_language_id, op10_media, op11_periodic_runs, op12_spelling_variants, op13_bestfit_packing, pipeline)}

#: Blocks and formatted length by SQL of its own: escapes double up, markers are counted.
_CHAT = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as same,
    length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) as body,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;')) as head
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(body + case when same then 8 else head + 18 end) as bigint) as formatted_chars
from w group by conv_id
"""

_LEAKS = """
with words as (
  select 'd' as side, doc_id as id, row_number() over () as rid, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents
  union all
  select 'i', item_id, row_number() over (), list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') from benchmark
), sh as (
  select side, id, rid, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from words
), sizes as (select rid, count(*) as n from sh where side = 'i' group by rid),
hits as (
  select d.rid as drid, any_value(d.id) as doc_id, i.rid as irid, any_value(i.id) as item_id, count(*) as n_shared
  from sh d join sh i on d.s = i.s and d.side = 'd' and i.side = 'i' group by d.rid, i.rid
)
select doc_id, item_id, n_shared, n as n_shingles, round(n_shared / n, 6) as containment
from hits join sizes on irid = rid where n_shared >= ceil(0.8 * n - 1e-9)
"""

ORACLE_SQL = {"op3_chat": _CHAT, "op7_decontamination": _LEAKS}
