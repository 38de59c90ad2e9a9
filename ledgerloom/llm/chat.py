"""Chat formatting by prefix-target expansion, in DataFrame operations alone.

Every assistant turn becomes its own example: all turns before it as context, its reply as the
only trainable text. Turns are wrapped in control strings, and control strings that occur inside
a text are escaped so that reading back gives the text as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings. A turn of another role names it between the last two.
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
USER, USER_END = "[INST]", "[/INST]"
REPLY, REPLY_END = "<s>", "</s>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
CONTROLS = (SYSTEM, SYSTEM_END, USER, USER_END, REPLY, REPLY_END, ROLE, ROLE_END)

#: The first character of a control string.
_HEADS = r"(<)(?=<SYS>>|</SYS>>|s>|/s>)|(\[)(?=/?(?:INST|ROLE)\])"
_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\].*?</s>"


def escaped(text: Column) -> Column:
    """Backslashes are doubled, and a control string gets one after its first character, so none is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _HEADS, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(role: Column, text: Column) -> Column:
    """One turn in the template."""
    body = escaped(text)
    return (
        F.when(role == "system", F.concat(F.lit(SYSTEM), body, F.lit(SYSTEM_END)))
        .when(role == "user", F.concat(F.lit(USER), body, F.lit(USER_END)))
        .when(role == "assistant", F.concat(F.lit(REPLY), body, F.lit(REPLY_END)))
        .otherwise(F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_END), body, F.lit(REPLY_END)))
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""

    def turn(t: Column) -> Column:
        inner = lambda a, b: F.substr(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b))
        other = inner(ROLE, REPLY_END)
        return (
            F.when(t.startswith(SYSTEM), F.struct(F.lit("system").alias("role"), unescaped(inner(SYSTEM, SYSTEM_END)).alias("text")))
            .when(t.startswith(USER), F.struct(F.lit("user").alias("role"), unescaped(inner(USER, USER_END)).alias("text")))
            .when(t.startswith(REPLY), F.struct(F.lit("assistant").alias("role"), unescaped(inner(REPLY, REPLY_END)).alias("text")))
            .otherwise(F.struct(unescaped(F.substring_index(other, ROLE_END, 1)).alias("role"), unescaped(F.substring_index(other, ROLE_END, -1)).alias("text")))
        )

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), turn)


def expand(turns: DataFrame) -> DataFrame:
    """Examples of a table of turns (conv_id, turn, role, text): conv_id, example, n_turns, text, loss_start, loss_chars.

    ``text`` is the formatted context and reply; ``loss_start`` (code points, from 0) and
    ``loss_chars`` mark the reply's text in it, the only trainable part. Turns after the last
    reply, and conversations without one, give an example with nothing trainable, so no turn is
    lost. Turns are ordered by turn, role and text; rows with an equal turn number all count,
    equal rows as often as they occur. Null roles and texts are empty, null turns come first,
    and rows without a conv_id form one conversation. A conversation is one row at a time.
    """
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wrapped = clean.select("conv_id", F.struct("turn", "role", "text", formatted(F.col("role"), F.col("text")).alias("out")).alias("t"))
    whole = wrapped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (F.get("ts", i - 1)["role"] == "assistant") | (i == F.size("ts")))
    each = whole.select("conv_id", "ts", F.posexplode(ends).alias("example", "upto"))
    last = F.get("ts", F.col("upto") - 1)
    text = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("upto")), lambda t: t["out"]), "")
    trained = last["role"] == "assistant"
    chars = F.when(trained, F.length(last["out"]) - len(REPLY) - len(REPLY_END)).otherwise(0)
    return each.select("conv_id", "example", F.col("upto").alias("n_turns"), text.alias("text"), chars.alias("loss_chars"), trained.alias("trained")).select(
        "conv_id", "example", "n_turns", "text", F.when(F.col("trained"), F.length("text") - len(REPLY_END) - F.col("loss_chars")).otherwise(F.length("text")).alias("loss_start"), "loss_chars"
    )


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    loss = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars")))
    read = examples.select("conv_id", "example", "text", loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    found = read.groupBy("conv_id").agg(F.max_by("text", "example").alias("longest"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))
    turns = found.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_examples")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
