"""Chat formatting with relational expressions only: turns to one string per conversation, and back.

Turns are collected as structs and sorted; adjacent turns of one role merge under one header by array
aggregation; the pieces are concatenated. With the marks of the template

    <s>[INST]user[/INST]first text[INST][/INST]second text of the same role</s>\\n

every control string inside a role or text gets one backslash after its first character, and one that
already has n backslashes there gets n + 1; taking one away again restores the text exactly. So no
unescaped control string is left in the texts, and the string splits back into the same turns. The
loss mask is an array of (start, length) spans over the string's code points, one for every text of
the trained role.

A conversation of any length is first collected in pieces of `piece` consecutive turn numbers, each a
group of its own, so that sorting and merging a very long one is spread over tasks; the last step
concatenates its pieces to the one string that its row holds.

Defined results: null texts and roles are empty; ties in the turn are ordered by role, then text;
null turns come first; repeated rows are turns of their own; rows with a null conversation id form
one conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, OPEN, CLOSE = "<s>", "</s>\n", "[INST]", "[/INST]"
JOIN = OPEN + CLOSE
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _header(role: Column) -> Column:
    return F.concat(F.lit(START + OPEN), role, F.lit(CLOSE))


def _between(before: Column, role: Column) -> Column:
    """What stands between a turn and the one before it: nothing but a join if the role goes on."""
    return F.when(before == role, F.lit(JOIN)).otherwise(F.concat(F.lit(END), _header(role)))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant", piece: int = 256) -> DataFrame:
    """One row per conversation: id, formatted, spans (array of start and length, the loss mask)."""
    rows = turns.select(
        F.col(id_col),
        F.floor(F.col(turn_col) / F.lit(piece)).alias("piece"),
        F.struct(F.col(turn_col).alias("turn"), escape(F.coalesce(F.col(role_col), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).alias("x"),
    )
    collected = rows.groupBy(id_col, "piece").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    no_spans = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def merge(acc: Column, x: Column) -> Column:
        lead = F.when(acc["n"] == 0, F.lit("")).otherwise(_between(acc["role"], x["role"]))
        start = F.length(acc["body"]) + F.length(lead)
        span = F.array(F.struct(start.cast("bigint").alias("start"), F.length(x["text"]).cast("bigint").alias("length")))
        spans = F.when(x["role"] == escape(F.lit(trained)), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["n"] + 1).alias("n"), x["role"].alias("role"), F.concat(acc["body"], lead, x["text"]).alias("body"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("n"), F.lit("").alias("role"), F.lit("").alias("body"), no_spans.alias("spans"))
    pieces = collected.select(id_col, "piece", F.col("turns")[0]["role"].alias("first"), F.aggregate("turns", empty, merge).alias("m"))
    whole = pieces.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("piece", "first", F.col("m.role").alias("last"), F.col("m.body").alias("body"), F.col("m.spans").alias("spans")))).alias("p"))
    lead = F.transform("p", lambda x, i: F.when(i == 0, _header(x["first"])).otherwise(_between(F.element_at(F.col("p"), F.greatest(i, F.lit(1)))["last"], x["first"])))
    whole = whole.withColumn("lead", lead)
    # where each piece's body starts: all leads so far and all bodies before it
    bases = F.aggregate(
        F.arrays_zip("lead", "p"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x["lead"]) + F.length(x["p"]["body"])).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(x["lead"]))).alias("out")),
        lambda acc: acc["out"],
    )
    whole = whole.withColumn("base", bases)
    text = F.concat(F.array_join(F.zip_with("lead", "p", lambda a, x: F.concat(a, x["body"])), ""), F.lit(END))
    spans = F.flatten(F.zip_with("base", "p", lambda b, x: F.transform(x["spans"], lambda s: F.struct((s["start"] + b).alias("start"), s["length"].alias("length")))))
    return whole.select(id_col, text.alias("formatted"), spans.alias("spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), merged turns apart again."""
    blocks = F.filter(F.split(formatted, END.replace("/", "\\/")), lambda b: b != "")
    pattern = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"

    def of_block(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, pattern, 1))
        return F.transform(F.split(F.regexp_extract(b, pattern, 2), r"\[INST\]\[/INST\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
