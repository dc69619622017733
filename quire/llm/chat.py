"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and its text alone is under the loss mask.

Template. An assistant turn is `<s>` text `</s>`; any other turn is `[INST]`
role LF text `[/INST]`. Inside roles and texts a backslash escapes: a backslash
becomes two, a control string gets one behind its first character, and a LF in
a role gets one before it. No control string is left in an escaped text, so
turns are read back by splitting at the control strings; deleting each backslash
and keeping the character behind it restores the text.

Defined results. A null text or role is the empty string. Turns are ordered by
turn, then role, then text, nulls first; repeated rows are repeated turns. A
conversation whose last turns have no reply gets one more row that ends with
them and has nothing under the mask, so no turn is lost. A null conv_id is a
conversation like any other. An empty table gives no rows. Other columns are
not read. An example holds its whole context, as the method has it: the output
is as large as the sum of all prefixes, and one conversation is put together in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_TURNS = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"
_ROLE = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n.*$"


def escaped(text: Column) -> Column:
    """The text without any control string; reversible by unescaped()."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_chars) of a table with conv_id, turn, role, text.

    example counts a conversation's rows from 0; n_turns are the turns in text;
    loss_start (from 0) and loss_chars bound the trainable code points of text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    reply = role == ASSISTANT
    body = escaped(text)
    shown = F.when(reply, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), body, F.lit("[/INST]"))
    )
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), shown.alias("shown"), reply.alias("reply"), F.length(body).alias("chars")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    target = F.transform("ts", lambda t, i: F.struct((i + 1).cast("long").alias("n_turns"), t["reply"].alias("reply"), t["chars"].alias("chars")))
    kept = F.filter(target, lambda t: t["reply"] | (t["n_turns"] == F.size("ts")))
    each = whole.select("conv_id", "ts", F.posexplode(kept).alias("example", "e"))
    full = each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("e.n_turns").alias("n_turns"),
        F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("e.n_turns").cast("int")), lambda t: t["shown"]), "").alias("text"),
        F.when(F.col("e.reply"), F.col("e.chars")).otherwise(0).cast("long").alias("loss_chars"),
    )
    start = F.when(F.endswith("text", F.lit("</s>")), F.length("text") - len("</s>") - F.col("loss_chars")).otherwise(F.length("text"))
    return full.select("conv_id", "example", "n_turns", "text", start.cast("long").alias("loss_start"), "loss_chars")


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    def turn(piece: Column) -> Column:
        inner = F.regexp_replace(piece, r"(?s)^(?:\[INST\]|<s>)(.*)(?:\[/INST\]|</s>)$", "$1")
        raw = F.regexp_extract(inner, _ROLE, 1)
        said = F.startswith(piece, F.lit("<s>"))
        return F.struct(
            F.when(said, F.lit(ASSISTANT)).otherwise(unescaped(raw)).alias("role"),
            unescaped(F.when(said, inner).otherwise(F.substr(inner, F.length(raw) + 2))).alias("text"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(_TURNS), F.lit(0)), turn)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say, read back: a row for each conversation."""
    loss = F.struct("example", unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))).alias("loss"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(loss)), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    said = whole.withColumn("turns", read_turns(F.col("longest")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"),
    )
