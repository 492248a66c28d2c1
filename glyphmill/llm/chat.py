"""Chat formatting with typed content parts, in DataFrame expressions only.

A conversation's turns become one string:

    <s>[INST]role NEWLINE content[/INST]</s>      for every role but assistant
    <s>role NEWLINE content</s>                   for the assistant

Control strings inside roles and texts are broken by one backslash after their
first character (`</s>` to `<\\/s>`); a control string that already holds
backslashes there gets one more, so the step can be undone exactly. The visitor
turns the parts of a turn into text in order: text parts are escaped, image,
audio and document parts become `<|image|>`, `<|audio|>` and `<|document|>`,
and each is recorded with its reference and the number of tokens it expands to.

The loss mask is a list of spans (start, length in code points) over the
formatted text, one for each assistant content.

Plain texts are turns of one text part and go through the visitor like all others.

Defined results: a null role or text counts as empty; turns sort by (turn,
role, text as it came with placeholders for what is not text, content,
attachments) with nulls first, so ties
and repeated rows have one order; rows
with a null conv_id form a conversation of their own; no rows give no rows;
further columns are ignored. A conversation is one value of the result, so its
turns do meet in one task; nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings, as what follows their first character.
_ANGLE, _SQUARE = r"/?s>|\|", r"/?INST\]"
TEMPLATE = {"open": "<s>", "close": "</s>", "ask": "[INST]", "asked": "[/INST]"}
#: Tokens that an attachment expands to: pixels a side of an image patch, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 512
KINDS = ("image", "audio", "document")
PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """text without a control string."""
    text = F.regexp_replace(text, rf"<(\\*)({_ANGLE})", r"<$1\\$2")
    return F.regexp_replace(text, rf"\[(\\*)({_SQUARE})", r"[$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    text = F.regexp_replace(text, rf"\[(\\*)\\({_SQUARE})", r"[$1$2")
    return F.regexp_replace(text, rf"<(\\*)\\({_ANGLE})", r"<$1$2")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """One text part."""
    absent = [F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *absent))


def visit(parts: Column, written: Callable[[Column], Column] = escape) -> Column:
    """The content string of typed parts, written says how their texts stand in it; a part of unknown type counts as text."""

    def one(part: Column) -> Column:
        return F.when(part["type"].isin(*KINDS), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(written(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PART)), one), "")


def attachments(parts: Column) -> Column:
    """kind, reference and expanded token count of each part that is not text, in order."""

    def tokens(p: Column) -> Column:
        side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(PATCH))
        many = F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        many = many.when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(FRAMES)))
        return F.greatest(F.lit(1).cast("long"), many.otherwise(F.coalesce(p["pages"], F.lit(0)) * F.lit(PAGE)).cast("long"))

    some = F.filter(F.coalesce(parts, F.array().cast(PART)), lambda p: p["type"].isin(*KINDS))
    return F.transform(some, lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("n_tokens")))


def format_chats(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments (ordered; index, kind, ref, n_tokens).

    turns has conv_id, turn, role and either text, then one text part a turn, or,
    named by parts_col, an array of parts as PART says. One shuffle, by conversation: the running
    offset and the grouping share it.
    """
    d, t = F.lit, TEMPLATE
    role = F.coalesce(turns["role"], d(""))
    parts = text_parts(turns["text"]) if parts_col is None else turns[parts_col].cast(PART)
    raw = visit(parts, lambda text: text)  # escapes change the order of texts
    rows = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), role.alias("role"), raw.alias("raw"), visit(parts).alias("content"), attachments(parts).alias("own"))
    said = F.col("role") == "assistant"
    head = F.concat(d(t["open"]), F.when(said, d("")).otherwise(d(t["ask"])), _role(F.col("role")), d("\n"))
    tail = F.concat(F.when(said, d("")).otherwise(d(t["asked"])), d(t["close"]))
    rows = rows.select("conv_id", "turn", "role", "raw", "content", "own", said.alias("said"), F.concat(head, "content", tail).alias("piece"), F.char_length(head).alias("ahead"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "raw", "content", "own").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), d(0))
    rows = rows.withColumn("start", start.cast("long"))
    span = F.struct((F.col("start") + F.col("ahead")).alias("start"), F.char_length("content").cast("long").alias("length"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "said", span.alias("span"), "own"))).alias("x"))
    listed = F.flatten(F.transform("x", lambda x: x["own"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("x", lambda x: x["said"]), lambda x: x["span"]).alias("loss_spans"),
        F.transform(listed, lambda a, i: F.struct(i.cast("long").alias("index"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))).alias("attachments"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array of struct(role, text); placeholders stay as they stand."""
    t = TEMPLATE
    pieces = F.split(formatted, F.lit(t["close"]))  # the last is what follows the last turn: empty
    bare = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(t["open"]) + 1), F.char_length(p)))
    asks = len(t["ask"]), len(t["asked"])
    inner = F.transform(bare, lambda p: F.when(F.startswith(p, F.lit(t["ask"])), F.substring(p, F.lit(asks[0] + 1), F.char_length(p) - sum(asks))).otherwise(p))
    cut = lambda p: F.instr(p, "\n")
    return F.transform(inner, lambda p: F.struct(_unrole(F.substring(p, F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substring(p, cut(p) + 1, F.char_length(p))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
