"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, and
only its text is trainable.  Turns after the last reply form one more example without a
trainable part, so the output holds every turn.  Inside texts and roles the characters
of the template's marks are escaped, so a text can never look like a mark and reading
back is exact.

Turns stand in order of (turn, role, text), nulls first; a repeated turn number keeps
every row.  A null role or text counts as empty; a null conv_id is a conversation of its
own.  A conversation is one row, since each of its examples repeats all of its earlier
turns anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, target (place of the last turn), formatted, loss_start, loss_length.

    The loss mask counts code points of ``formatted`` from 0; a row without a trainable
    part has length null.
    """
    empty = F.lit("")
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    mark = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(">"))
    pieces = F.transform("turns", lambda t: F.concat(mark(t), escape(t["text"]), F.lit(CLOSE)))
    targets = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("i"), (t["role"] == TRAINED_ROLE).alias("trained"))),
        lambda x: x["trained"] | (x["i"] == F.size("turns") - 1),
    )
    row = F.col("x")
    last = F.get(F.col("turns"), row["i"])
    before = F.array_join(F.slice("pieces", F.lit(1), row["i"]), "")
    return (
        whole.select("conv_id", "turns", pieces.alias("pieces"), F.explode(targets).alias("x"))
        .select(
            "conv_id",
            row["i"].alias("target"),
            row["trained"].alias("trained"),
            before.alias("before"),
            F.get(F.col("pieces"), row["i"]).alias("piece"),
            F.length(mark(last)).alias("mark"),
            F.length(escape(last["text"])).alias("reply"),
        )
        .select(
            "conv_id",
            "target",
            F.concat("before", "piece").alias("formatted"),
            F.when(F.col("trained"), F.length("before") + F.col("mark")).alias("loss_start"),
            F.when(F.col("trained"), F.col("reply")).alias("loss_length"),
        )
    )


def trained_text(examples: DataFrame) -> Column:
    """The trainable part of an example, unescaped; null without one."""
    return unescape(
        F.substring(F.col("formatted"), F.col("loss_start") + F.lit(1), F.col("loss_length"))
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as (role, text)."""
    pieces = F.split(formatted, CLOSE)
    inner = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, ">", 1)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + 2)).alias("text")
        )

    return F.transform(inner, turn)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read from them alone."""
    read = examples.select("conv_id", "target", "formatted", trained_text(examples).alias("reply"))
    reply = F.struct("target", "reply")
    whole = read.groupBy("conv_id").agg(
        parse(F.max_by("formatted", "target")).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), reply))).alias("replies"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
