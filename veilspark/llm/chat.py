"""Chat formatting with typed content parts, in DataFrame expressions only.

A message's content is a list of parts: text, image, audio or document.  The
visitor turns the parts of a turn, in order, into one string: texts with their
control strings escaped, other parts into a placeholder ``[MEDIA]kind[/MEDIA]``
(parts after the first are preceded by ``[PART]``), with a reference recorded beside it (turn, part, kind, ref) and the number of
tokens the placeholder expands to.  A turn is

    <s>[INST]role[/INST]content</s>

and the loss mask is the list of spans (code points) of the assistant turns'
content.  Escaping puts one backslash after the first character of a control
string (``</s>`` becomes ``<\\/s>``) and one more where backslashes already
stand there, so it can be undone and no control string is left in a text.

Scale: one shuffle by conversation; the work is in proportion to the turns of a
conversation, which is one row.

Defined results: null text, role or ref count as empty; turns are in order of
turn (nulls first), ties by role, then content; very long texts are kept whole; repeated rows are repeated
turns; conversations with a null id are one conversation; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE, END_ROLE, MEDIA, END_MEDIA = "<s>", "</s>", "[INST]", "[/INST]", "[MEDIA]", "[/MEDIA]"
PART_MARK = "[PART]"
#: Turns whose starts are summed in one array.
BLOCK = 64
#: First character, any backslashes, rest of a control string.
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\]|/?MEDIA\]|PART\])"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?MEDIA\]|PART\])"

#: The type of a content part; texts use only ``text``.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def text_part(c: Column) -> Column:
    """A content list of one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("width"), F.lit(None).alias("height"), F.lit(None).alias("seconds"), F.lit(None).alias("pages")).cast(PART))


@dataclass(frozen=True)
class ChatFormatter:
    """Tokens per placeholder: image patches, audio frames, document pages."""

    patch: int = 14
    frames_per_second: float = 25.0
    tokens_per_page: int = 512
    learn_from: str = "assistant"

    def _visit(self, p: Column) -> Column:
        blank = lambda c: F.coalesce(c, F.lit(""))
        return F.when(p["kind"] == "text", escape(blank(p["text"]))).otherwise(F.concat(F.lit(MEDIA), escape(blank(p["kind"])), F.lit(END_MEDIA)))

    def _tokens(self, p: Column) -> Column:
        side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / self.patch)
        return (
            F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
            .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.frames_per_second))
            .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * self.tokens_per_page)
            .otherwise(F.lit(0))
            .cast("long")
        )

    def turns(self, messages: DataFrame) -> DataFrame:
        """messages: conv_id, turn, role, content (array of parts).  Adds the formatted turn."""
        role = F.coalesce(F.col("role"), F.lit(""))
        content = F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>"))
        media = F.filter(F.transform(content, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), self._tokens(p).alias("tokens"))), lambda m: ~m["kind"].eqNullSafe("text"))
        head = F.concat(F.lit(OPEN + ROLE), escape(role), F.lit(END_ROLE))
        return (
            messages.select("conv_id", "turn", "role", "content")
            .withColumn("head", head)
            .withColumn("body", F.array_join(F.transform(content, self._visit), PART_MARK))
            .withColumn("media", media)
            .select("conv_id", "turn", role.alias("role"), "head", "body", "media", (role == self.learn_from).alias("learn"))
        )

    def format(self, messages: DataFrame) -> DataFrame:
        """Per conversation: conv_id, formatted, turn_starts, loss (array of start, length and position of the turn), media, media_tokens."""
        turns = self.turns(messages)
        row = F.struct("turn", "role", "body", "head", "learn", "media")
        convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
        text = lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
        convs = convs.withColumn("formatted", F.array_join(F.transform("t", text), ""))
        # a turn begins where the closing marks before it end: their places are found in one pass
        convs = convs.withColumn("turn_starts", starts_of(F.col("formatted"), F.size("t")))
        span = F.transform("t", lambda t, i: F.struct(t["learn"].alias("learn"), i.alias("position"), (F.get("turn_starts", i) + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))
        loss = F.transform(F.filter(span, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"], s["position"]))
        media = F.flatten(F.transform("t", lambda t, i: F.transform(t["media"], lambda m: F.struct(i.alias("position"), t["turn"].alias("turn"), m["part"], m["kind"], m["ref"], m["tokens"]))))
        convs = convs.withColumn("loss", loss).withColumn("media", media)
        total = F.aggregate("media", F.lit(0).cast("long"), lambda acc, m: acc + m["tokens"])
        return convs.select("conv_id", "formatted", "turn_starts", "loss", "media", total.alias("media_tokens"))


def starts_of(formatted: Column, turns: Column) -> Column:
    """Code points before each turn.

    The text is cut at its closing marks (there is none inside a turn) and sums of the lengths
    are taken block by block, in blocks of ``BLOCK`` turns, so the cost is in proportion to the turns.
    """
    lengths = F.transform(F.slice(F.split(formatted, CLOSE.replace("/", "\\/"), -1), F.lit(1), turns), lambda p: (F.length(p) + len(CLOSE)).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((turns - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, n: acc + n)
    running = lambda xs, first: F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    heads = running(F.transform(blocks, total), F.lit(0).cast("long"))
    return F.flatten(F.zip_with(blocks, heads, running))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of (role, text): the inverse of the format."""
    pieces = F.split(formatted, CLOSE.replace("/", "\\/"), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = lambda p: F.locate(END_ROLE, p)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN + ROLE) + 1), cut(p) - F.lit(len(OPEN + ROLE) + 1))).alias("role"),
            unescape(F.substring(p, cut(p) + F.lit(len(END_ROLE)), F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, turn_starts: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped span by span; ``position`` tells in which turn a span lies."""
    pieces = F.split(formatted, CLOSE.replace("/", "\\/"), -1)
    inside = lambda s: F.substring(F.get(pieces, s["position"]), (s["start"] - F.get(turn_starts, s["position"]) + 1).cast("int"), s["length"].cast("int"))
    return F.array_join(F.transform(loss, lambda s: unescape(inside(s))), "")
