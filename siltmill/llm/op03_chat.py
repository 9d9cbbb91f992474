"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted for each conversation, adjacent turns of one role share a block, and an array
aggregation lays out the blocks and the spans that carry loss. Markers start with `<`; inside texts and roles `&` and
`<` (in roles also `|`) are written as entities, so no text can forge a marker and everything can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, HEAD, MORE, END = "<|turn:", "|>\n", "<|more|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&bar;"), F.lit("|")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("|"), F.lit("&bar;"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length in characters of formatted) for rows conv_id, turn, role, text.

    Null texts and roles are empty. Turns sort by number (null first), then role and text; repeated rows stay. Rows of
    a null conv_id are one conversation. Other columns are ignored. An empty table gives no rows. A conversation is
    one value of the result, so its size is bounded by what a row can hold.
    """
    t = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))

    def piece(x: Column, i: Column) -> Column:
        same = F.coalesce((i > 0) & (F.get(F.col("_ts"), i - 1)["role"] == x["role"]), F.lit(False))
        head = F.concat(F.when(i > 0, END).otherwise(""), F.lit(TURN), escape_role(x["role"]), F.lit(HEAD))
        return F.struct(F.when(same, MORE).otherwise(head).alias("before"), escape(x["text"]).alias("body"), x["role"].isin(*loss_roles).alias("loss"))

    g = g.select("conv_id", F.transform("_ts", piece).alias("_p"))
    spans = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["before"]) + F.length(p["body"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.concat(F.array_join(F.transform("_p", lambda p: F.concat(p["before"], p["body"])), ""), F.lit(END))
    return g.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_texts (array): what format_chats wrote, parsed from its output alone."""
    blocks = F.slice(F.split("formatted", r"<\|turn:", -1), 2, 1 << 30)

    def turns_of(b: Column) -> Column:
        role = F.substring_index(b, HEAD, 1)
        body = F.substring(b, F.length(role) + len(HEAD) + 1, F.length(b) - F.length(role) - len(HEAD) - len(END))
        return F.transform(F.split(body, r"<\|more\|>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_texts"))
