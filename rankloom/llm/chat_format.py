"""Chat formatting with Spark expressions only.

Layout of one conversation::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n<|im_start|>...

Turns are sorted, adjacent turns of one role share a block (texts parted by ``<|im_sep|>``)
and the blocks are concatenated. Control strings in texts cannot be mistaken for
markers: ``<`` + n backslashes + ``|`` is written with n + 1 backslashes, so that
``<|`` never occurs inside a text and the original comes back exactly.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role,
text) with null turns first, so repeated turn numbers and repeated rows are all kept in
a stable order; rows with a null conv_id form one conversation; texts of any length are
escaped whole, one segment in memory; an empty table gives no rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Turn numbers that share a segment. A conversation of any length is formatted in
#: parts of this many turn numbers, so that no task holds more than a part of it.
SEGMENT_TURNS = 256


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """Roles stand on one line, so newlines, ``<`` and backslashes are written as two characters."""
    out = F.replace(c, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("<"), F.lit("\\l"))


def unescape_role(c: Column) -> Column:
    out = F.replace(c, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("s"), loss.alias("loss"))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Formats conversations; one row per segment of ``segment_turns`` turn numbers.

    Returns conv_id, segment, formatted, spans (array of start and length in code points
    of ``formatted``: the texts of ``loss_role``, escapes included). The segments of a
    conversation, in order, concatenate to its whole formatted string; a block that runs
    on into the next segment is closed there.
    """
    rows = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-(2**62))).cast("long").alias("segment"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = F.expr(
        """aggregate(turns, cast(array() as array<struct<role: string, texts: array<string>>>),
             (acc, t) -> if(size(acc) > 0 and try_element_at(acc, -1).role = t.role,
                            concat(slice(acc, 1, size(acc) - 1),
                                   array(named_struct('role', t.role, 'texts', array_append(try_element_at(acc, -1).texts, t.text)))),
                            array_append(acc, named_struct('role', t.role, 'texts', array(t.text)))))"""
    )
    order = Window.partitionBy("conv_id").orderBy("segment")
    merged = turns.select("conv_id", "segment", blocks.alias("blocks"))
    merged = merged.select(
        "*",
        F.coalesce(F.lag(F.element_at("blocks", -1)["role"]).over(order) == F.element_at("blocks", 1)["role"], F.lit(False)).alias("continues"),
        F.coalesce(F.lead(F.element_at("blocks", 1)["role"]).over(order) == F.element_at("blocks", -1)["role"], F.lit(False)).alias("goes_on"),
    )

    def pieces(block: Column, i: Column) -> Column:
        inside = F.transform(
            block["texts"],
            lambda text, j: F.array(
                _piece(F.when(j > 0, F.lit(SEP)).otherwise(F.lit("")), F.lit(False)),
                _piece(escape_text(text), block["role"] == F.lit(loss_role)),
            ),
        )
        head = F.when((i == 0) & F.col("continues"), F.lit(SEP)).otherwise(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")))
        tail = F.when((i == F.size("blocks") - 1) & F.col("goes_on"), F.lit("")).otherwise(F.lit(END))
        return F.concat(F.array(_piece(head, F.lit(False))), F.flatten(inside), F.array(_piece(tail, F.lit(False))))

    cut = merged.select("conv_id", "segment", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    spans = F.expr(
        """aggregate(pieces, named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
             (acc, p) -> named_struct('at', acc.at + length(p.s),
                                      'spans', if(p.loss, array_append(acc.spans, named_struct('start', acc.at, 'length', cast(length(p.s) as bigint))), acc.spans)),
             acc -> acc.spans)"""
    )
    return cut.select("conv_id", "segment", F.concat_ws("", F.transform("pieces", lambda p: p["s"])).alias("formatted"), spans.alias("spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Reads formatted segments back: conv_id, formatted (whole), turns (array of role and text), loss_text.

    Works from the strings and the spans alone; texts under the loss mask are unescaped
    and put one after the other with nothing between.
    """
    loss = F.concat_ws("", F.transform("spans", lambda s: unescape_text(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    parts = formatted.select("conv_id", F.struct("segment", "formatted", loss.alias("loss")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.select(
        "conv_id",
        F.concat_ws("", F.transform("parts", lambda p: p["formatted"])).alias("formatted"),
        F.concat_ws("", F.transform("parts", lambda p: p["loss"])).alias("loss_text"),
    )

    def turns_of(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = unescape_role(F.substring(block, F.lit(1), at - 1))
        body = F.substring(block, at + 1, F.length(block) - at - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda text: F.struct(role.alias("role"), unescape_text(text).alias("text")))

    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)
    return whole.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), "loss_text")
