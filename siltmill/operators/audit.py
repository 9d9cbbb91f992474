"""Grounding audit, quote attribution and response shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, baht_ceilings, page_range, to_arabic

# How sections, clauses and circulars are cited; the method with a ceiling; words of its exceptions and
# of special cases; the general ceiling in baht.
SECTION, CLAUSE, CIRCULAR = r"(?:มาตรา|ม\.)\s*(\d+)", r"ข้อ\s*(\d+)", r"(ว\s*\d+)"
SPECIFIC = "เฉพาะเจาะจง"
EXCEPTIONS = ["ข้อยกเว้น", "จำเป็นเร่งด่วน", "ฉุกเฉิน", "มีรายเดียว", "วรรคสอง"]
SPECIAL = ["สถานศึกษา", "กระทรวงศึกษาธิการ", "ส่งเสริมหรือสนับสนุน", "ส่งเสริมการเรียนการสอน"]
CEILING = 500_000


def cited(text: Column, pattern: str) -> Column:
    """Different first groups of a pattern in the text with Arabic digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(to_arabic(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))))


def grounding(answers: DataFrame, answer: Column, context: Column, section_numbers: Column | None = None, clause_numbers: Column | None = None, ceiling: int = CEILING) -> DataFrame:
    """answers with sections, clauses, circulars (what the answer cites), ungrounded_sections, ungrounded_clauses,
    over_budget, wrong_ceilings, score and passed.

    Grounded is what the contexts' texts cite and the numbers that they carry (arrays of integers). More than half of the
    cited sections ungrounded fails; ungrounded clauses only warn. An answer on the specific method fails when it states
    a ceiling above the general one without a special case, and warns of budgets above it without an exception. score:
    the grounded share of sections and clauses, 1 when none is cited; an empty answer fails with 0.
    """
    none = F.array().cast("array<string>")
    numbers = lambda c: none if c is None else F.transform(F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda x: x.isNotNull() & (x != 0)), lambda x: x.cast("string"))
    text = to_arabic(F.coalesce(answer, F.lit("")))
    a = answers.withColumns({"sections": cited(answer, SECTION), "clauses": cited(answer, CLAUSE), "circulars": cited(answer, CIRCULAR)})
    a = a.withColumns(
        {
            "ungrounded_sections": F.array_except("sections", F.concat(cited(context, SECTION), numbers(section_numbers))),
            "ungrounded_clauses": F.array_except("clauses", F.concat(cited(context, CLAUSE), numbers(clause_numbers))),
        }
    )
    specific = F.contains(text, F.lit(SPECIFIC))
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"(?:วงเงิน|งบประมาณ)\s*([\d,]+)\s*บาท"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))
    empty_amounts = F.array().cast("array<bigint>")
    over = F.when(specific & ~any_of(text, EXCEPTIONS), F.filter(amounts, lambda x: x > ceiling)).otherwise(empty_amounts)
    wrong = F.when(specific & ~any_of(text, SPECIAL), F.filter(baht_ceilings(text), lambda x: x > ceiling)).otherwise(empty_amounts)
    a = a.withColumns({"over_budget": over, "wrong_ceilings": wrong})
    empty = text == ""
    n, bad = F.size("sections") + F.size("clauses"), F.size("ungrounded_sections") + F.size("ungrounded_clauses")
    passed = ~empty & ~(F.size("ungrounded_sections") > F.size("sections") / 2) & (F.size("wrong_ceilings") == 0)
    return a.withColumns({"score": F.bround(F.when(empty, 0.0).when(n == 0, 1.0).otherwise((n - bad) / n), 2), "passed": passed})


def squeezed(c: Column) -> Column:
    return F.regexp_replace(to_arabic(F.coalesce(c, F.lit(""))), r"\s+", "")


def attribute_quotes(quotes: DataFrame, chunks: DataFrame, records: DataFrame) -> DataFrame:
    """quote_id, law, quote, filename, page of quotes (quote_id, answer_id, law, quote).

    chunks: what each answer was given (answer_id, chunk_id, ord, entry, text, tenant, kind, num, doc); records: chunk_id,
    source_file, title, page_start, page_end, total_pages of the store; records of corpus chunks also doc, kind, num.
    A quote belongs to the answer's first tenant chunk whose text holds it (ten characters or more, the first 60
    compared), whose title and the law's name hold one another, or that stands on the named page of the only document
    with that page; else to the first chunk of the same unit of the same document; else to the store's unit of that
    document and number; else to nothing.
    """
    law = F.col("law")
    q = quotes.withColumns({"_target": squeezed(F.substring_index(law, "|", 1)), "_quote": F.substring(squeezed(F.col("quote")), 1, 60), "_page": F.regexp_extract(to_arabic(law), r"หน้า\s*(\d+)", 1)})
    flat = to_arabic(F.regexp_replace(F.regexp_replace(law, r"\|", " "), r"\s+", " "))
    unit = r"^(.*?)(มาตรา|ข้อ)\s*(\d+)"
    q = q.withColumns({"_kind": F.when(F.regexp_extract(flat, unit, 2) == "มาตรา", "section").when(F.regexp_extract(flat, unit, 2) == "ข้อ", "clause"), "_num": F.regexp_extract(flat, unit, 3).try_cast("int"), "_doc": F.replace(F.regexp_extract(flat, unit, 1), F.lit(" "))})
    own = chunks.where("tenant").withColumn("_title", squeezed(F.substring_index("entry", "|", 1)))
    near = q.join(own, "answer_id")
    on_page = (F.col("_page") != "") & F.endswith("entry", F.concat(F.lit("หน้า "), F.col("_page")))
    titles = F.size(F.collect_set(F.when(on_page, F.col("_title"))).over(Window.partitionBy("quote_id")))
    holds = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    quoted = (F.length("_quote") >= 10) & F.contains(squeezed(F.col("text")), F.col("_quote"))
    near = near.withColumn("_one", titles == 1).where(quoted | holds(F.col("_title"), F.col("_target")) | (F.col("_one") & on_page))
    tenant = near.select("quote_id", F.lit(0).alias("_step"), "ord", "chunk_id")
    doc = F.replace(to_arabic(F.col("c.doc")), F.lit(" "))
    same = q.alias("q").join(chunks.alias("c"), (F.col("q.answer_id") == F.col("c.answer_id")) & (F.col("q._kind") == F.col("c.kind")) & (F.col("q._num") == F.col("c.num"))).where(~F.col("c.tenant") & holds(F.col("q._doc"), doc))
    given = same.select("q.quote_id", F.lit(1).alias("_step"), "c.ord", "c.chunk_id")
    known = records.where("kind is not null").alias("c")
    store = q.alias("q").join(known, (F.col("q._kind") == F.col("c.kind")) & (F.col("q._num") == F.col("c.num"))).where(holds(F.col("q._doc"), doc))
    stored = store.select("q.quote_id", F.lit(2).alias("_step"), F.lit(0).alias("ord"), "c.chunk_id")
    first = tenant.unionByName(given).unionByName(stored).groupBy("quote_id").agg(F.min_by("chunk_id", F.struct("_step", "ord", "chunk_id")).alias("chunk_id"))
    found = first.join(records.select("chunk_id", "source_file", "title", "page_start", "page_end", "total_pages"), "chunk_id", "left")
    out = quotes.join(found, "quote_id", "left")
    return out.select("quote_id", F.nullif("law", F.lit("")).alias("law"), "quote", F.coalesce("source_file", "title").alias("filename"), page_range(F.col("page_start"), F.col("page_end"), F.col("total_pages")).alias("page"))


def audit_rows(attempts: DataFrame) -> DataFrame:
    """One audit row for each attempt, failed ones too (query_id, org_id, question, result struct or null, error, latency_ms).

    Status is the result's, else ERROR where there is an error; lists that are missing are empty.
    """
    r = F.col("result")
    empty = F.array().cast("array<string>")
    return attempts.select(
        "query_id",
        "org_id",
        F.col("question").alias("user_query"),
        F.coalesce(r["status"], F.when(F.col("error").isNotNull(), "ERROR")).alias("status"),
        F.coalesce(r["clause_ids"], empty).alias("retrieved_clause_ids"),
        F.coalesce(r["laws"], empty).alias("citations"),
        r["answer"].alias("synthesized_answer"),
        r["passed"].alias("grounded"),
        r["score"].alias("grounding_score"),
        "latency_ms",
        "error",
    )


# What stands for nothing.
EMPTY_MARKS = ["", "-", "ไม่มี", "none", "null", "n/a"]


def unresolved(issues: DataFrame) -> DataFrame:
    """Issues of a response that stay open: those whose status, RESOLVED where it is missing, is another. Missing aspects
    that say nothing are null."""
    aspect = F.trim(F.coalesce("missing_aspect", F.lit("")))
    return issues.where(F.coalesce("status", F.lit("RESOLVED")) != "RESOLVED").withColumn("missing_aspect", F.when(~F.lower(aspect).isin(EMPTY_MARKS), aspect))


def merge_by_law(quotes: DataFrame, laws: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes and laws of one response in one row for each law; empty marks become null."""
    blank = lambda c: F.when(~F.lower(F.trim(c)).isin(EMPTY_MARKS), c)
    return quotes.withColumn("quote", blank(F.col("quote"))).join(laws.withColumn("reason", blank(F.col("reason"))), keys, "full")
