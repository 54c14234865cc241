"""Chat formatting (4): grammar round trip, DataFrame functions only.

Grammar of a rendered conversation:

    conversation := turn*
    turn         := "### " role ":\\n" text "</turn>\\n"

A deterministic parser reads it back by splitting at turn marks.  Each
conversation is first rendered with its texts as they are and reparsed; a turn
whose recovered role or text differs from its source holds conflicting content
and is rendered escaped; rendering and reparsing are repeated until every turn
is identical, and a conversation that still differs raises an error.  Escapes:
``\\b`` for a backslash, ``\\h`` for ``#`` and ``\\l`` for ``<`` wherever these
stand in a text that needs it; roles always use them, and ``\\c`` for ``:`` and
``\\n`` for a line feed besides.  An escaped text holds neither mark, so the
second round always ends.

Rows of a conversation are ordered by turn, then role, then text (nulls first);
repeated rows are turns of their own; null roles and texts are empty; rows
without a conv_id form one conversation with a null id; an empty table gives no
rows; extra columns are ignored.  A conversation is one output row, so one
conversation must fit one row (2 GB).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ":\n", "</turn>\n"
#: What a text must not show unescaped: the marks of the grammar.
MARKS = (OPEN, "</turn>")
TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n"))


def _escape(c: Column, escapes) -> Column:
    for raw, code in escapes:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _unescape(c: Column, escapes) -> Column:
    for raw, code in reversed(escapes):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def render(turns: Column) -> Column:
    """Rendered conversation of array<struct<role, text, escaped>>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), _escape(t["role"], ROLE_ESCAPES), F.lit(ROLE_END),
        F.when(t["escaped"], _escape(t["text"], TEXT_ESCAPES)).otherwise(t["text"]), F.lit(CLOSE))), "")


def parse(rendered: Column) -> Column:
    """array<struct<role, raw, text>> of a rendered conversation; raw is the text as it stands there.

    Every opening mark begins a turn.  A piece without a role mark or with
    anything but one closing mark at its end yields null fields.
    """
    pieces = F.filter(F.split(rendered, "\\Q" + OPEN + "\\E", -1), lambda p, i: i > 0)

    def turn(p):
        role_len = F.instr(p, ROLE_END)
        raw = F.substr(p, role_len + F.lit(len(ROLE_END)), F.length(p) - role_len - F.lit(len(ROLE_END) + len(CLOSE) - 1))
        sound = (role_len > 0) & p.endswith(CLOSE) & ~F.contains(raw, F.lit(MARKS[1]))
        role = F.when(sound, _unescape(F.substr(p, F.lit(1), role_len - 1), ROLE_ESCAPES))
        return F.struct(role.alias("role"), F.when(sound, raw).alias("raw"),
                        F.when(sound, _unescape(raw, TEXT_ESCAPES)).alias("text"))

    return F.transform(pieces, turn)


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turns, formatted, loss_spans) from rows (conv_id, turn, role, text).

    loss_spans are (start, length) in code points of the formatted text: the
    texts of turns whose role is loss_role, as they stand there.
    """
    empty = F.lit("")
    one = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                   F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    convs = rows.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"),
                                                     F.lit(False).alias("escaped")))
    # first round: texts as they are; a piece that differs, or shifts the pieces after it, is conflicting content
    convs = convs.select("conv_id", source.alias("turns"))
    convs = convs.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"), _conflicts(t).alias("escaped"))))
    convs = convs.withColumn("formatted", render(F.col("turns"))).withColumn("parsed", parse(F.col("formatted")))
    identical = (F.size("parsed") == F.size("turns")) & F.forall(
        F.arrays_zip("parsed", "turns"), lambda z: _same(z["parsed"], z["turns"]))
    convs = convs.withColumn("formatted", F.when(identical, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("round trip differs in conversation "), F.col("conv_id").cast("string")))))
    lengths = F.transform("parsed", lambda p: F.length(p["raw"]))
    heads = F.transform("parsed", lambda p: F.lit(len(OPEN) + len(ROLE_END)) + F.length(_escape(p["role"], ROLE_ESCAPES)))
    steps = F.arrays_zip(heads.alias("head"), lengths.alias("length"),
                         F.transform("parsed", lambda p: p["role"] == loss_role).alias("loss"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(steps, start, lambda acc, s: F.struct(
        (acc["at"] + s["head"] + s["length"] + F.lit(len(CLOSE))).alias("at"),
        F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + s["head"]).alias("start"), s["length"].alias("length")))))
        .otherwise(acc["spans"]).alias("spans")))
    return convs.select("conv_id", "turns", "formatted", walked["spans"].alias("loss_spans"))


def _conflicts(t: Column) -> Column:
    """Does a turn rendered as it is come back different?  Turns are parsed apart, as marks never span two."""
    back = parse(render(F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"), F.lit(False).alias("escaped")))))
    return ~((F.size(back) == 1) & F.coalesce(_same(F.get(back, F.lit(0)), t), F.lit(False)))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of (conv_id, formatted, loss_spans) recovers; the sources play no part."""
    parsed = parse(F.col("formatted"))
    turns = F.array_join(F.transform("parsed", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: _unescape(
        F.substr(F.col("formatted"), s["start"] + 1, s["length"]), TEXT_ESCAPES)), "")
    return (formatted.select("conv_id", "formatted", "loss_spans", parsed.alias("parsed"))
            .select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))
