"""Retrieval in rounds: questions that found nothing are put in other words and asked again, a bounded number of times.

A round searches only what is still open, for all such questions at once; candidates of all rounds are merged by best score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def found_any(hits: DataFrame) -> DataFrame:
    return hits.select("query_id").distinct()


def ask_in_rounds(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    rewrite: Callable[[Column, int], Column],
    key: str,
    retries: int = 2,
    settled: Callable[[DataFrame], DataFrame] = found_any,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> tuple[DataFrame, DataFrame]:
    """(hits, states) of questions (query_id, text; one row each).

    search: query_id, key, score of questions. settled: the query_ids that a round's hits satisfy; the others go on with
    rewrite(text, round), round from 1, until `retries` are used up. A rewrite that gives null or the same text ends a
    question. hits: query_id, key, score, round: each candidate's best score and the first round that gave it (0: as
    asked). states: query_id, searches, settled. keep(df, name) stores a table that the next round reads; without it plans
    grow with each round.
    """
    waiting = keep(questions.select("query_id", "text"), "questions")
    found, ended = [], []
    for turn in range(retries + 1):
        hits = keep(search(waiting).select("query_id", key, "score").withColumn("round", F.lit(turn)), "round-hits")
        found.append(hits)
        done = keep(settled(hits).select("query_id").distinct(), "settled")
        ended.append(waiting.join(done, "query_id", "left_semi").select("query_id", F.lit(turn + 1).alias("searches"), F.lit(True).alias("settled")))
        rest = waiting.join(done, "query_id", "left_anti").withColumn("_new", rewrite(F.col("text"), turn + 1) if turn < retries else F.lit(None).cast("string"))
        goes_on = F.coalesce(F.col("_new") != F.col("text"), F.lit(False))
        ended.append(rest.where(~goes_on).select("query_id", F.lit(turn + 1).alias("searches"), F.lit(False).alias("settled")))
        if turn == retries:
            break
        waiting = keep(rest.where(goes_on).select("query_id", F.col("_new").alias("text")), "questions")
        if waiting.isEmpty():
            break
    best = Window.partitionBy("query_id", key).orderBy(F.col("score").desc(), "round")
    merged = _union(found).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return merged, _union(ended)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
