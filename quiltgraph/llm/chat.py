"""Chat formatting of turns with typed content parts, in built-in column functions only.

Every turn becomes ``<|im_start|>ROLE<|im_sep|>CONTENT<|im_end|>``. A visitor walks the content parts in
order: text is escaped; an image, audio or document part becomes a numbered placeholder, and its
reference and expanded token count are recorded. Inside texts and roles, ``<``, any backslashes and
``|`` get one backslash more, so that no text holds a control string and taking one backslash away
gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END, PART = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|part|>"

#: Fixed tokens of a placeholder and tokens for each of its units (image tiles, seconds, pages).
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (0, 512)}

PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, r"<(\\*)\|", r"<\\$1|")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"<\\(\\*)\|", r"<$1|")


def text_part(col: Column) -> Column:
    """The content parts of a plain text (null: empty)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(col, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(PARTS)


def _is_text(p: Column) -> Column:
    return ~F.coalesce(p["type"], F.lit("text")).isin(*EXPANSION)


def _tokens(p: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for kind, (fixed, each) in EXPANSION.items():
        out = F.when(p["type"] == kind, F.lit(fixed) + F.lit(each) * F.coalesce(p["units"], F.lit(1))).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, loss_spans, attachments.

    loss_spans are the contents of assistant turns as code points of ``formatted`` (start, end exclusive).
    attachments lists (turn_index, ordinal, kind, ref, tokens); ``ordinal`` is the number in the placeholder,
    counted within the turn. A part of another or no type is text, a null text empty, null parts no
    part, a missing unit count one. Turns are ordered by turn (null first), then role, then parts; a null
    role is an empty role; the null conversation id is a conversation; repeated rows are turns of their
    own. Other columns are ignored; an empty table gives an empty result. The rows of one conversation meet in one task, as
    its string does, so its texts, each of any length, must together fit a string (2 GB). What an assistant says in several
    parts is learnt as it is written: the separators and placeholders between its own parts are under the loss mask.
    """
    p = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    held = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), turns[parts_col].cast(PARTS).alias("parts")
    )
    media = F.filter(p, lambda x: ~_is_text(x))
    shown = F.transform(
        p,
        lambda x, i: F.when(_is_text(x), escape(F.coalesce(x["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), x["type"], F.lit(":"), (F.size(F.filter(F.slice(p, F.lit(1), i + 1), lambda y: ~_is_text(y)))).cast("string"), F.lit("|>"))
        ),
    )
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    held = held.withColumn("body", F.array_join(shown, PART)).withColumn("head", head)
    held = held.withColumn("attached", F.transform(media, lambda x, i: F.struct((i + 1).alias("ordinal"), x["type"].alias("kind"), x["ref"].alias("ref"), _tokens(x).alias("tokens"))))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("head") + F.char_length("body") + F.lit(len(END))
    held = (
        held.withColumn("n", length.cast("long"))
        .withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("i", F.row_number().over(by_turn))
        .withColumn("from", F.col("at") + F.char_length("head"))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
    )
    span = F.struct(F.col("from").alias("start"), (F.col("from") + F.char_length("body")).alias("end"))
    grouped = held.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "piece", "attached"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"),
    )
    attachments = F.flatten(
        F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct((t["i"] - 1).alias("turn_index"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    return grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "loss_spans", attachments.alias("attachments")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, content>> of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>"), lambda x: x != "")
    halves = F.transform(pieces, lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("content")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
