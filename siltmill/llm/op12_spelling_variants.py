"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so words of the same letters share it and one
letter more, fewer or another changes it by a known value. Each word stands under its key and, once for each different
letter, under the key without it: a word whose key equals another's key less one letter has one letter fewer, and two
words that meet with a letter of each taken away differ by the exchange value of those letters. Letters out of order are
told apart afterwards: words that are one edit apart share the first or the last half of what is left, by which the keys'
groups are split before they are joined, and the edit distance of each pair that remains is taken.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Latin-1 letters from À on and A to Z in small letters; all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_MODULUS = (1 << 61) - 1  # keys stay below, also those of words of millions of letters
_HELD = 300_000  # different words that a task holds before it hands their counts on


def word_counts(docs: DataFrame, least_letters: int = 6, dropping: int | None = None) -> DataFrame:
    """word, n: how often the texts of docs (doc_id, text) have each maximal run of letters [A-Za-zÀ-ÿ], A to Z in small
    letters, of least_letters or more.

    dropping: makes misspellings for measurements: of a document's run whose crc32 of "doc_id:run" this number divides, the
    letter at crc32 modulo length is left out first. Null texts have no words; rows without an id keep theirs as they are;
    repeated rows count as often as they stand; other columns are ignored; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (text := text.as_py()) is None:
                    continue
                runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                head = zlib.crc32(f"{doc}:".encode())
                for run, n in runs.items():
                    if len(run) < least_letters:
                        continue
                    if dropping and doc is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                        if h % dropping == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_letters:
                                continue
                    total[run] += n
                size += len(text)
                if len(total) > _HELD or size > 64_000_000:
                    yield _batch(total)
                    total.clear()
                    size = 0
        if total:
            yield _batch(total)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _batch(total: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def _value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def reduced_keys(words: DataFrame) -> DataFrame:
    """word, n, left (letters that the key stands for), key, letter (taken away; empty: none): a row for the whole word and
    one for each different letter of it."""
    letters = F.filter(F.split("word", ""), lambda x: x != "")
    keyed = words.select("word", "n", letters.alias("_l")).withColumn("_k", F.aggregate("_l", F.lit(0).cast("long"), lambda s, x: (s + _value(x)) % _MODULUS))
    rows = keyed.select("word", "n", "_k", F.size("_l").alias("_n"), F.explode(F.array_append(F.array_distinct("_l"), F.lit(""))).alias("letter"))
    whole = F.col("letter") == ""
    key = F.when(whole, F.col("_k")).otherwise(F.pmod(F.col("_k") - _value(F.col("letter")), F.lit(_MODULUS)))
    return rows.select("word", "n", (F.col("_n") - F.when(whole, 0).otherwise(1)).alias("left"), key.alias("key"), "letter")


def _shuffled(a: DataFrame, b: DataFrame, on: Column | str | list, how: str) -> DataFrame:
    """A join by sorted shuffles whatever the sizes: a vocabulary grows with the texts, so no side of it is broadcast."""
    return a.join(b.hint("merge"), on, how)


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of different words (word, n; no word twice) that one inserted, deleted or replaced letter
    parts, once."""
    half = F.floor(F.col("left") / 2).cast("int")
    head, tail = F.left("word", half), F.right("word", F.col("left") - half)
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.xxhash64(h).alias("half")) for i, h in enumerate((head, tail))))
    rows = reduced_keys(words).select("word", "n", "left", "key", "letter", F.inline(sides))
    a = rows.alias("a")
    b = rows.where("letter <> ''").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "left", "side", "half")]
    longer = F.col("a.letter") == ""
    exchanged = (F.col("a.letter") != F.col("b.letter")) & (F.col("a.word") < F.col("b.word"))
    cut = F.floor(F.col("a.left") / 2).cast("int")
    once = (F.col("a.side") == 0) | (F.left(F.col("a.word"), cut) != F.left(F.col("b.word"), cut))
    pairs = _shuffled(a, b, [*same, longer | exchanged, once], "inner").where(F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form; no cycles): the last word of each chain. A round doubles the steps it looks ahead."""
    table = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = table.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ahead = _shuffled(table, up, F.col("root") == F.col("_w"), "left")
        further = stored(ahead.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "variant-roots")
        discard(table)
        table = further
        if further.where("moved").isEmpty():
            return further.select("word", "root")


def spelling_variants(counts: DataFrame, least: int = 5, factor: int = 5, least_letters: int = 6) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of counts (word, n) with n >= least and least_letters or more.

    n_near: words that one letter parts from it. form: the near word of largest n (ties: the first by code points), if that
    n is at least factor times the word's, else null, with its n. root: where a chain of forms ends; a word without form
    is its own. Words are letters A to Z, a to z, À to ÿ, each in one row (word_counts gives them so). An empty table gives
    no rows. Chains have at most log_factor(largest n) steps, so that followed() takes few rounds.
    """
    words = stored(counts.where((F.col("n") >= least) & (F.char_length("word") >= least_letters)).select("word", "n"), "variant-words")
    pairs = near_words(words)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    groups = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = _shuffled(words, groups, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    table = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")),
        "variant-table",
    )
    discard(words)
    roots = followed(table.where("form is not null"))
    return _shuffled(table, roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
