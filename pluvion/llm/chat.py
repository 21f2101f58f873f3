"""Operator 7: relational chat formatting, with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are merged by array
aggregation, and the text is concatenated:

    block        := <s> role [INST] text ( [/INST] text )* </s>
    conversation := block*

A block holds a run of turns of one role; ``[/INST]`` parts its turns. Control strings
inside roles and texts are escaped by a backslash after their first character
(``[INST]`` becomes ``[\\INST]``; one that has backslashes there already gets one more), so
no control string of the template occurs inside a text, and unescaping takes one backslash
away again. The loss mask lists the spans (code points) of assistant texts in the output.

Defined results: null text and null role count as empty; turns of equal number are ordered
by role and text; a null turn number comes first; rows with a null conv_id form one
conversation; repeated rows are repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.llm.common import running_total

#: The template's control strings without their first characters (fixed values).
_TAIL = r"(/?INST\]|/?s>|<SYS>>|</SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def format_chats(df: DataFrame, assistant: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start and length).

    One shuffle, on the conversation; a conversation is one output row, so its turns meet in
    one task by definition.
    """
    turns = df.select(
        df[conv_col].alias("conv_id"), df[turn_col].alias("turn"),
        F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    opens = F.filter(index, lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    blocks = sorted_turns.withColumn("opens", opens).withColumn(
        "blocks",
        F.transform(
            "opens",
            lambda at, k: F.struct(
                F.col("turns")[at]["role"].alias("role"),
                F.transform(
                    F.slice("turns", at + 1, F.coalesce(F.get("opens", k + 1), F.size("turns")) - at),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    )
    # Every block as strings: its head, its texts with the marks that follow them.
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(F.concat(F.lit("<s>"), escape(b["role"]), F.lit("[INST]")).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, j: F.array(
                            F.struct(t.alias("s"), (b["role"] == assistant).alias("loss")),
                            F.struct(F.when(j == F.size(b["texts"]) - 1, "</s>").otherwise("[/INST]").alias("s"), F.lit(False).alias("loss")),
                        ),
                    )
                ),
            ),
        )
    )
    laid = blocks.select("conv_id", parts.alias("parts"))
    laid = laid.withColumn("ends", running_total(F.transform("parts", lambda p: F.char_length(p["s"]).cast("long"))))
    spans = F.filter(
        F.transform(
            F.arrays_zip("parts", "ends"),
            lambda z: F.struct(z["parts"]["loss"].alias("loss"), (z["ends"] - F.char_length(z["parts"]["s"])).alias("start"), F.char_length(z["parts"]["s"]).cast("long").alias("length")),
        ),
        lambda s: s["loss"],
    )
    return laid.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, unescaped) and loss_text, from the output alone."""
    bodies = F.transform(
        F.filter(F.split("formatted", "</s>", -1), lambda b: F.startswith(b, F.lit("<s>"))),
        lambda b: F.split(F.substr(b, F.lit(4)), r"\[INST\]", 2),
    )
    turns = F.flatten(
        F.transform(
            bodies,
            lambda b: F.transform(F.split(b[1], r"\[/INST\]", -1), lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text"))),
        )
    )
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")
