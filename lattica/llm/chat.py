"""Operator 4: chat formatting by prefix-target expansion, with DataFrame and SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are
context and its text alone is trainable. Turns after the last assistant turn
are kept in one more example without a trainable reply, so that the output
holds the whole conversation.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. ``<|`` never
stands in a text: ``<`` + n backslashes + ``|`` is written with n+1
backslashes. In roles, backslash and newline are escaped as well.

A conversation is the unit of the format: its last example holds all of its
turns, so its turns meet in one row. Turns are ordered by turn, then role,
then text, nulls first; repeated rows are repeated turns. Null texts and roles
are empty; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    # escaped backslashes are cut out from the left, so what is left of a run is the backslash of a newline
    parts = F.split(unescape(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars) of ``turns(conv_id, turn, role, text)``: the formatted text and its trainable span."""
    text, role = F.coalesce(turns["text"], F.lit("")), F.coalesce(turns["role"], F.lit(""))
    grouped = turns.select("conv_id", F.struct(turns["turn"].alias("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    made = grouped.select(
        "conv_id", F.transform("turns", lambda t: F.struct(
            (t["role"] == "assistant").alias("reply"), F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body"),
            F.concat(head(t), escape(t["text"]), F.lit(END + "\n")).alias("text"))).alias("turns"))
    n = F.size("turns")
    last = F.sequence(F.lit(1), n)
    made = made.withColumn("i", F.explode(F.filter(last, lambda i: F.element_at(F.col("turns"), i)["reply"] | (i == n))))
    at = F.element_at("turns", F.col("i"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("i")), lambda t: t["text"]), "")
    made = made.select("conv_id", F.col("i").alias("example"), text.alias("text"), at["reply"].alias("reply"), F.length(at["text"]).alias("tail"), at["head"].alias("head"), at["body"].alias("body"))
    start = F.when(F.col("reply"), F.length("text") - F.col("tail") + F.col("head"))
    return made.select("conv_id", "example", "text", start.alias("loss_start"), F.when(F.col("reply"), F.col("body")).otherwise(0).alias("loss_chars"))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turns, their digest, and the text under the loss mask."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    per = made.select("conv_id", "example", "text", F.when(F.col("loss_start").isNotNull(), loss).otherwise("").alias("loss"), F.length("text").cast("long").alias("chars"))
    got = per.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"))
    # the first part is empty; each other part is ROLE \n TEXT <|im_end|> \n
    every = F.split("whole", r"<\|im_start\|>")
    parts = F.slice(every, F.lit(2), F.size(every) - 1)

    def turn(p):
        cut = F.instr(p, "\n")
        role = unescape_role(F.substring(p, F.lit(1), cut - 1))
        body = unescape(F.substring(p, cut + 1, F.length(p) - cut - len(END) - 1))
        return F.concat(role, F.lit("\n"), body, F.lit("\n"))

    turns = F.transform(parts, turn)
    return got.select("conv_id", F.size(parts).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
