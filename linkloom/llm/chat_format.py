"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role share a block, in which a separator keeps the turns apart:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Inside texts and roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so
no text can hold a control string, and the formatted string reads back to the
turns it came from.  Every array step is linear in the turns of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: The role that a model learns from.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, segments.

    ``segments`` are (piece, loss) structs whose pieces join to ``formatted``;
    the pieces with ``loss`` are the escaped texts of the assistant.  Turns
    are ordered by turn, then role, then text, so ties and repeated rows have
    one order; a null turn comes first; null roles and texts are empty; rows
    with a null conversation id form one conversation.  Other columns are
    ignored.  An empty table gives no rows.  A conversation is one output
    value and must fit in one, which Spark limits to 2 GB.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def pieces(x: Column, i: Column) -> Column:
        name = F.replace(escape(x["role"]), F.lit("\n"), F.lit("&nl;"))
        same = (i > 0) & (F.get("t", i - 1)["role"] == x["role"])
        head = F.when(same, F.lit(SEP)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), name, F.lit("\n")))
        return F.array(
            F.struct(head.alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("piece"), (x["role"] == LEARNED).alias("loss")),
        )

    end = F.array(F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")))
    talks = talks.select("conv_id", F.concat(F.flatten(F.transform("t", pieces)), end).alias("segments"), F.size("t").alias("_n"))
    return talks.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text) structs."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        cut = F.instr(block, "\n")
        name = unescape(F.replace(block.substr(F.lit(len(START) + 1), cut - len(START) - 1), F.lit("&nl;"), F.lit("\n")))
        texts = F.split(block.substr(cut + 1, F.length(block)), r"<\|im_sep\|>")
        return F.transform(texts, lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`format_conversations` gave, read back: counts and digests of its turns and of what is learned."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "").alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
