"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, the reply
itself the only trainable span. Turns after the last reply (or a conversation without
one) make a closing example without a trainable span, so that no turn is lost.

Defined cases: a null text is empty; a null role is the empty role and a null conv_id
a conversation of its own; repeated rows are repeated turns; ties of ``turn`` are
ordered by role, then text, and a null turn comes first. An empty table gives no
examples. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
#: A word joiner set behind the first character of a control string; texts that hold some already get one more.
MARK = "⁠"
REST = r"\||/?s>"
INST = r"/?INST\]"


def escaped(text: Column) -> Column:
    """Breaks every control string inside a text; ``unescaped`` restores the text exactly."""
    return F.regexp_replace(text, rf"(<{MARK}*)(?={REST})|(\[{MARK}*)(?={INST})", f"$1$2{MARK}")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<{MARK}*){MARK}(?={REST})|(\[{MARK}*){MARK}(?={INST})", "$1$2")


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, last, formatted, loss_start, loss_length): one row per example.

    The loss span counts code points of ``formatted`` from 0. The work is that of the
    method: a conversation of n turns is written out up to n times.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), t["role"].alias("role")
        ),
    )
    size = F.size("shown")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (F.get("shown", i - 1)["role"] == "assistant") | (i == size))
    rows = rows.select("conv_id", shown.alias("shown")).select("conv_id", "shown", F.posexplode(ends).alias("example", "end"))
    target, before = F.element_at("shown", F.col("end")), F.slice("shown", F.lit(1), F.col("end") - 1)
    context = F.concat(F.array_join(F.transform(before, lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""), target["head"])
    trained = target["role"] == "assistant"
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("end") == size).alias("last"),
        F.concat(context, target["body"], F.lit(END)).alias("formatted"),
        F.when(trained, F.char_length(context).cast("long")).alias("loss_start"),
        F.when(trained, F.char_length(target["body"]).cast("long")).otherwise(F.lit(0).cast("long")).alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>."""
    parts = F.split(F.substring(formatted, F.lit(1), F.char_length(formatted) - len(END)), r"<\|end\|>\n", -1)
    cut = lambda p: F.instr(p, MIDDLE)
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(p, cut(p) + len(MIDDLE), F.char_length(p))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, parsed from ``formatted`` and the loss span alone."""
    said = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    each = examples.select(
        "conv_id",
        "example",
        F.when(F.col("last"), read_back(F.col("formatted"))).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), said).alias("said"),
        F.char_length("formatted").cast("long").alias("chars"),
    ).select(
        "conv_id",
        "example",
        "said",
        "chars",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"),
    )
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "said"))), lambda x: x["said"]), "")
    return each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), told.alias("told"), F.sum("chars").alias("formatted_chars")
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("told").cast("long").alias("loss_chars"),
        F.sha2(F.col("told").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
