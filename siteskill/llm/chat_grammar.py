r"""Chat formatting that is checked by reading it back.

Grammar: a conversation is a row of turns `<|im_start|>ROLE\nTEXT<|im_end|>\n`. `recovered` is a deterministic
parser for it that refuses everything else: a control string inside a turn makes it fail. `formatted` renders a
conversation plainly, reparses it, and compares the turns; only if they differ is the conversation
rendered again with its conflicting content escaped, and compared again.

Escaping adds one backslash inside every `<\*|` (so `<|im_end|>` becomes `<\|im_end|>`), reading takes one
away; inside a role a line break becomes `<n|`. Both directions are one-to-one, so any text comes back.

Edge cases: null roles and texts count as empty, rows with a null turn come first, equal turns are ordered by
role and text, repeated rows stay, rows with a null conv_id form one conversation. Other columns are ignored.
An empty table gives an empty result. A conversation becomes one row, as its output is one string.
Everything is a DataFrame expression; the one shuffle is by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(\\*)(n?)\|", r"<\\$1$2|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?)\|", "<$1$2|")


def rendered(turns: Column, escaped: bool) -> Column:
    role, text = (escape_role, escape) if escaped else (lambda x: x, lambda x: x)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t["role"]), F.lit("\n"), text(t["text"]), F.lit(END + "\n"))), "")


def _segments(formatted: Column) -> Column:
    """The raw turns: what follows each start marker, cut at the first line break and the first end marker."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def cut(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring_index(F.substr(part, F.length(role) + 2), END, 1)
        return F.struct(role.alias("role"), body.alias("body"), (part == F.concat(role, F.lit("\n"), body, F.lit(END + "\n"))).alias("whole"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), cut)


def recovered(formatted: Column) -> Column:
    """The turns (role, text, loss) that a formatted conversation holds; null if it breaks the grammar."""
    segments = _segments(formatted)
    sound = F.forall(segments, lambda s: s["whole"]) & (formatted.startswith(START) | (formatted == ""))
    read = F.transform(segments, lambda s: F.struct(
        unescape_role(s["role"]).alias("role"), unescape(s["body"]).alias("text"), (unescape_role(s["role"]) == LOSS_ROLE).alias("loss")
    ))
    return F.when(sound, read)


def loss_runs(formatted: Column) -> Column:
    """The loss mask of a formatted conversation as runs (chars, loss) that cover it from start to end."""
    return F.flatten(F.transform(_segments(formatted), lambda s: F.array(
        F.struct((F.length(s["role"]) + len(START) + 1).cast("bigint").alias("chars"), F.lit(False).alias("loss")),
        F.struct(F.length(s["body"]).cast("bigint").alias("chars"), (unescape_role(s["role"]) == LOSS_ROLE).alias("loss")),
        F.struct(F.lit(len(END) + 1).cast("bigint").alias("chars"), F.lit(False).alias("loss")),
    )))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped (whether the plain form conflicted), same (whether the turns came back)."""
    turns = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    told = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    source = lambda: F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == LOSS_ROLE).alias("loss")))
    plain = told.withColumn("plain", rendered(F.col("turns"), False)).withColumn("escaped", ~recovered(F.col("plain")).eqNullSafe(source()))
    final = plain.withColumn("formatted", F.when(F.col("escaped"), rendered(F.col("turns"), True)).otherwise(F.col("plain")))
    return final.select("conv_id", "formatted", "escaped", (~F.col("escaped") | recovered(F.col("formatted")).eqNullSafe(source())).alias("same"))
