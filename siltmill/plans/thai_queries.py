"""Thai words and search over them, on the driver's documents written in Thai letters without spaces between words.

Each Latin word (a to z) becomes a leading vowel and a consonant for each letter, so SQL knows the words that must come out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.segment import large_segmenter
from ..operators import retrieval as R
from ..session import bound_batches
from .tables import bm25_sql, passages, query, scratch, table, tok, top_sql

# A consonant for each letter; the vowel that opens each word.
LETTERS, CONSONANTS, OPENING = "abcdefghijklmnopqrstuvwxyz", "กขคงจฉชซญฎดตถทธนบปผฝพฟภมยร", "เ"


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def thai_word(word: Column) -> Column:
    return F.concat(F.lit(OPENING), F.translate(word, LETTERS, CONSONANTS))


def thai_words(text: Column) -> Column:
    return F.transform(latin_words(text), thai_word)


def thai_documents(spark, sf):
    """doc_id, text: the words of each line without spaces, lines apart."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z\n]+", " "), "[a-z]+", f"{OPENING}$0")
    return table(spark, sf, "documents").select("doc_id", F.translate(words, f"{LETTERS} ", CONSONANTS).alias("text"))  # without the spaces


def dictionary(spark, sf):
    """The different words of documents and passages. A stated dictionary: the driver's vocabulary, which grows with the documents."""
    texts = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
    latin = texts.select(F.explode(latin_words(F.col("text"))).alias("word")).distinct()
    return latin.select(thai_word(F.col("word")).alias("word"))


def _sql_words(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+'), lambda w: '{OPENING}' || translate(w, '{LETTERS}', '{CONSONANTS}'))"


@query(f"select doc_id, len(w) as n_words, md5(array_to_string(w, ' ')) as words_md5 from (select doc_id, {_sql_words('text')} as w from documents)")
def thai_segments(spark, sf):
    """Each document's words, found again in text without spaces."""
    bound_batches(spark)
    words = large_segmenter(dictionary(spark, sf))(F.col("text"))
    return thai_documents(spark, sf).select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_DOCS = f"tdocs as (select doc_id, array_to_string({_sql_words('text')}, ' ') as text from documents), tq as (select item_id as query_id, array_to_string({_sql_words('text')}, ' ') as text from benchmark)"


@query(f"with {_DOCS}, {bm25_sql('tdocs', 'tq').replace(tok('text'), 'list_filter(string_split(text, chr(32)), lambda x: length(x) > 1)')}, {top_sql('scores', 'top', 'doc_id', 10)} select * from top")
def thai_bm25_topk(spark, sf):
    """BM25 over Thai documents for Thai passages, both cut by the same segmenter."""
    bound_batches(spark)
    cut = large_segmenter(dictionary(spark, sf))
    asked = passages(spark, sf).select("query_id", F.array_join(thai_words(F.col("text")), "").alias("text"))
    folder = scratch(spark, "thai-index")
    R.save_index(thai_documents(spark, sf), folder, tokenize=cut)
    return R.bm25_top(R.open_index(spark, folder), asked, 10, tokenize=cut)
