"""Chat formatting with DataFrame functions only.

A declarative template names the marker of each role, the end of a turn and the
roles whose text is learned from.  A finite-state machine over the roles judges
the order of turns.  Texts are escaped so that no marker can appear in them:
backslash, # and < become \\\\, \\h and \\l, which reads back one way only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
#: The colon ends a role, so it is escaped there, too.
IN_ROLES = (*ESCAPES, (":", "\\c"))
START = ""


@dataclass(frozen=True)
class Template:
    """``roles``: name in the marker of each known role; other roles appear after an @.

    ``moves``: which role may follow which (START before the first turn);
    ``last``: roles that may end a conversation.
    """

    roles: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    opening: str = "### "
    after_role: str = ": "
    closing: str = " </turn>\n"
    learned: tuple = ("assistant",)
    moves: tuple = ((START, "system"), (START, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    last: tuple = ("assistant",)


DEFAULT = Template()


def escape(c: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    """Pairs of backslashes cut the text; between them a letter names the other characters."""

    def part(p):
        for plain, coded in pairs[1:]:
            p = F.replace(p, F.lit(coded), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def _role(c: Column, t: Template) -> Column:
    """The role as it stands in a marker."""
    out = F.concat(F.lit("@"), escape(c, IN_ROLES))
    for role, name in t.roles.items():
        out = F.when(c == role, F.lit(name)).otherwise(out)
    return out


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per segment: conv_id, turn, place, part, role, segment, learned, valid.

    Each turn gives three segments in order of ``part``: its marker, its
    escaped text and its end; ``learned`` is the loss flag, true for texts of
    the template's learned roles.  ``place`` numbers a conversation's turns by
    turn, role and text.  ``valid`` says whether the machine allows the turn
    after the one before it, and for the last turn whether the conversation may
    end there.

    * Null text or role: empty.  Null turns come first; null conv_ids form one
      conversation.  Repeated rows are turns of their own.
    * Other columns are not looked at.  Empty table: empty result.
    """
    t = template
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.lag("role").over(order).alias("before"),
        F.lead("role").over(order).isNull().alias("at_end"),
    )
    first = F.coalesce(F.col("before"), F.lit(START))
    allowed = F.lit(False)
    for a, b in t.moves:
        known = F.col("before").isNull() if a == START else F.col("before").isNotNull()
        allowed = allowed | (known & (first == a) & (F.col("role") == b))
    valid = allowed & (~F.col("at_end") | F.col("role").isin(*t.last))
    pieces = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit(t.opening), _role(F.col("role"), t), F.lit(t.after_role)).alias("segment"), F.lit(False).alias("learned")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text")).alias("segment"), F.col("role").isin(*t.learned).alias("learned")),
        F.struct(F.lit(2).alias("part"), F.lit(t.closing).alias("segment"), F.lit(False).alias("learned")),
    )
    rows = rows.select("conv_id", "turn", "place", "role", valid.alias("valid"), F.explode(pieces).alias("p"))
    return rows.select("conv_id", "turn", "place", "p.part", "role", "p.segment", "p.learned", "valid")


def assemble(parts: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, valid.

    ``formatted`` is the conversation's text; ``spans`` are the pieces of it
    under the loss mask, as (start, length) in characters, in order.
    """
    order = Window.partitionBy("conv_id").orderBy("place", "part")
    length = F.char_length("segment")
    placed = parts.withColumn("length", length).withColumn("start", (F.sum(length).over(order) - length).cast("int"))
    item = F.struct("place", "part", "segment", "learned", "start", "length")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("s"), F.min("valid").alias("valid"))
    spans = F.transform(F.filter("s", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.col("s.segment"), "").alias("formatted"), spans.alias("spans"), "valid")


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in " \n" else c for c in s)


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns in a formatted text, as an array of (role, text)."""
    t = template
    turns = F.filter(F.split(formatted, _literal(t.closing), -1), lambda x: x.startswith(t.opening))
    head = f"(?s)^{_literal(t.opening)}([^:]*){_literal(t.after_role)}(.*)$"

    def one(x):
        name = F.regexp_extract(x, head, 1)
        role = unescape(F.substring(name, 2, 2**31 - 1), IN_ROLES)
        for known, shown in t.roles.items():
            role = F.when(name == shown, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text"))

    return F.transform(turns, one)


def learned_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
