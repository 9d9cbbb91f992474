"""Information-retrieval, evidence and citation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import bare_item, unit_of

from ..functions.text import any_of, doc_key, normal_evidence, same_document


def at_cutoffs(results: DataFrame, targets: DataFrame, cutoffs: list[int], query: str = "query_id", item: str = "item") -> DataFrame:
    """query, k, precision, adjusted_precision, recall, hit, mrr (4 decimals) for ranked results (query, item, rank).

    Every query of targets or results counts. Precision divides by k; adjusted by the smaller of k and the number of
    targets. A query without targets has 1 everywhere.
    """
    t = targets.select(query, item).distinct()
    sizes = t.groupBy(query).agg(F.count("*").alias("_t"))
    flagged = results.select(query, item, "rank").join(t.withColumn("_hit", F.lit(1)), [query, item], "left")
    queries = results.select(query).union(t.select(query)).distinct()
    grid = queries.select(query, F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    got = grid.join(flagged, query, "left").where(F.col("rank").isNull() | (F.col("rank") <= F.col("k")))
    got = got.groupBy(query, "k").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("_rel"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"))
    g = grid.join(got, [query, "k"], "left").join(sizes, query, "left")
    rel, n = F.coalesce("_rel", F.lit(0)), F.col("_t")
    one = lambda c: F.round(F.when(n.isNull(), 1.0).otherwise(c), 4)
    return g.select(
        query,
        "k",
        one(rel / F.col("k")).alias("precision"),
        one(F.least(F.lit(1.0), rel / F.least("k", n))).alias("adjusted_precision"),
        one(rel / n).alias("recall"),
        one((rel > 0).cast("double")).alias("hit"),
        one(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
    )


def holds_evidence(results: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """results (keys, doc, text) joined with the spans (keys, span_id, doc, span) that they hold: the same document, and
    the span in the text, both as evidence text. Blank spans match nothing."""
    r = results.withColumns({"_key": doc_key(F.col("doc")), "_text": normal_evidence(F.col("text"))}).drop("doc", "text")
    s = spans.select(*keys, "span_id", doc_key(F.col("doc")).alias("_want"), normal_evidence(F.col("span")).alias("_span"))
    hit = same_document(F.col("_want"), F.col("_key")) & (F.col("_span") != "") & F.contains("_text", "_span")
    return r.join(s, keys).where(hit).drop("_key", "_text", "_want", "_span")


def evidence(results: DataFrame, spans: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """query, recall, hit, all_found, mrr, precision of evidence spans (query, span_id, doc, span) in ranked texts (query,
    rank, doc, text).

    Precision divides by the texts returned, at most k.
    """
    r = results.where(F.col("rank") <= k)
    n = spans.groupBy(query).agg(F.count("*").alias("_n"))
    returned = r.groupBy(query).agg(F.count("*").alias("_r"))
    h = holds_evidence(r, spans, [query]).groupBy(query).agg(F.countDistinct("span_id").alias("_f"), F.min("rank").alias("_first"), F.countDistinct("rank").alias("_good"))
    f = F.coalesce("_f", F.lit(0))
    return n.join(h, query, "left").join(returned, query, "left").select(
        query,
        F.round(f / F.col("_n"), 4).alias("recall"),
        (f > 0).cast("int").alias("hit"),
        (f == F.col("_n")).cast("int").alias("all_found"),
        F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce(F.coalesce("_good", F.lit(0)) / F.col("_r"), F.lit(0.0)), 4).alias("precision"),
    )


def match_predictions(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """predictions (pred_id, ord, case_id or null, question) with case_key of the case they answer: by id (the place when
    there is none), else by the trimmed question, else null. Of cases of one id or question the last counts."""
    last = Window.partitionBy("_k").orderBy(F.col("ord").desc())
    one = lambda c: cases.select(c.alias("_k"), F.col("case_key"), "ord").where("_k <> ''").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("_k", "case_key")
    by_id = one(F.coalesce(F.col("case_id"), F.col("ord").cast("string"))).withColumnRenamed("case_key", "_a")
    by_text = one(F.trim("question")).withColumnRenamed("case_key", "_b")
    p = predictions.withColumns({"_id": F.coalesce(F.col("case_id"), F.col("ord").cast("string")), "_q": F.trim("question")})
    p = p.join(by_id, F.col("_id") == by_id["_k"], "left").drop("_k").join(by_text, F.col("_q") == by_text["_k"], "left").drop("_k")
    return p.withColumn("case_key", F.coalesce("_a", "_b")).drop("_a", "_b", "_id", "_q")


# What a status or an answer without law says.
NO_LAW, NO_LAW_TEXTS = "NO_LAW_FOUND", ["ไม่พบข้อกฎหมาย", "NO_LAW_FOUND"]


def with_law(predictions: DataFrame, status: str = "status", answer: str = "answer") -> DataFrame:
    """Predictions that found law, by status and by what the answer says."""
    a = F.coalesce(F.col(answer), F.lit(""))
    return predictions.where(~((F.coalesce(F.col(status), F.lit("")) == NO_LAW) | any_of(a, NO_LAW_TEXTS)))


def hit_rates(cases: DataFrame) -> DataFrame:
    """One row: total_cases and the counts and percentages of document, section and strict (both) hits, and mean recall,
    of cases (document_hit, section_hit, recall)."""
    both = F.col("document_hit") & F.col("section_hit")
    n = F.count("*")
    share = lambda c: F.round(F.coalesce(F.count_if(c) * 100 / F.nullif(n, F.lit(0)), F.lit(0.0)), 4)
    return cases.agg(
        n.alias("total_cases"),
        F.count_if(F.col("document_hit")).alias("document_hits"),
        share(F.col("document_hit")).alias("document_hit_rate"),
        F.count_if(F.col("section_hit")).alias("section_hits"),
        share(F.col("section_hit")).alias("section_hit_rate"),
        F.count_if(both).alias("strict_hits"),
        share(both).alias("strict_hit_rate"),
        F.round(F.coalesce(F.avg("recall") * 100, F.lit(0.0)), 4).alias("mean_recall_at_k"),
    )


def citation_scores(truth: Column, said: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two sets: 1 without truth, 0 without candidates."""
    both = F.size(F.array_intersect(truth, said))
    nt, ns = F.size(F.array_distinct(truth)), F.size(F.array_distinct(said))
    p = F.when(nt == 0, 1.0).when(ns == 0, 0.0).otherwise(both / ns)
    r = F.when(nt == 0, 1.0).otherwise(both / nt)
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f, 4)}


def inherit_last(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """A missing reference takes the last one before it in the same document."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def with_inherited_units(pairs: DataFrame, keys: list[str], order: str, section: str = "section") -> DataFrame:
    """pairs in which a section of bare items takes the last unit named before it (within keys, by order): `มาตรา 96 วรรคหนึ่ง
    (2)`, then `(5)`, means `มาตรา 96 (5)`. Without one before it, it stays."""
    unit = F.nullif(unit_of(F.col(section)), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.withColumn("_unit", unit).withColumn("_last", F.last("_unit", ignorenulls=True).over(w))
    takes = F.col("_unit").isNull() & bare_item(F.col(section)) & F.col("_last").isNotNull()
    return rows.withColumn(section, F.when(takes, F.concat_ws(" ", "_last", F.trim(section))).otherwise(F.col(section))).drop("_unit", "_last")


def expand_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two lists of one length pair up by place; of different lengths, every one with every other."""
    same = F.size(a) == F.size(b)
    zipped = F.transform(F.arrays_zip(a, b), lambda x: F.struct(x[a].alias("a"), x[b].alias("b")))
    crossed = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return df.withColumn("_p", F.explode(F.when(same, zipped).otherwise(crossed))).withColumns({"doc": F.col("_p.a"), "section": F.col("_p.b")}).drop("_p")
