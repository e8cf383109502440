"""Subtitle styles as Column expressions: inline markup to text and runs, styles at a character, colours and alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a style.
BOLD, ITALIC, UNDERLINE, STRIKEOUT = 1, 2, 4, 8
_BITS = {"b": BOLD, "i": ITALIC, "u": UNDERLINE, "s": STRIKEOUT}
_RUNS = "array<struct<start:int,end:int,style:int>>"


def srt_styled(markup: Column) -> Column:
    """(text, runs, alignment) of SubRip markup: ``<b> <i> <u> <s>`` become runs of a bit mask, fonts and overrides are dropped,
    ``{\\anN}`` gives the alignment (2 without one), and any other tag stays text."""
    plain = F.regexp_replace(F.coalesce(markup, F.lit("")), "\r\n", "\n")
    tokens = F.regexp_extract_all(plain, F.lit(r"(?is)<\s*/?\s*(?:[bius]|font\b[^>]*|/font)\s*>|\{\\[^}]*\}|[^<{]+|[<{]"), F.lit(0))
    tag = lambda t: F.lower(F.regexp_replace(t, r"[<>\s]", ""))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("style"), F.array().cast(_RUNS).alias("runs"))

    def step(s: Column, t: Column) -> Column:
        name, style = tag(t), s["style"]
        is_tag = F.rlike(t, F.lit(r"(?is)^<.+>$"))
        for key, bit in _BITS.items():
            style = F.when(is_tag & (name == key), s["style"].bitwiseOR(F.lit(bit))).when(is_tag & (name == f"/{key}"), s["style"].bitwiseAND(F.lit(15 - bit))).otherwise(style)
        dropped = is_tag | F.rlike(t, F.lit(r"^\{\\"))
        at = F.length(s["text"])
        last = F.try_element_at(s["runs"], F.lit(-1))
        joins = (last["end"] == at) & (last["style"] == s["style"])
        run = F.array(F.struct(F.when(joins, last["start"]).otherwise(at).alias("start"), (at + F.length(t)).alias("end"), s["style"].alias("style")))
        before = F.when(joins, F.slice(s["runs"], 1, F.greatest(F.size(s["runs"]) - 1, F.lit(0)))).otherwise(s["runs"])
        runs = F.when(dropped | (s["style"] == 0), s["runs"]).otherwise(F.concat(before, run).cast(_RUNS))
        return F.struct(F.when(dropped, s["text"]).otherwise(F.concat(s["text"], t)).alias("text"), style.alias("style"), runs.alias("runs"))

    folded = F.aggregate(tokens, start, step)
    alignment = F.coalesce(F.nullif(F.regexp_extract(plain, r"\{\\[^}]*an([1-9])", 1), F.lit("")).cast("int"), F.lit(2))
    return F.struct(folded["text"].alias("text"), folded["runs"].alias("runs"), alignment.alias("alignment"))


def style_at(runs: Column, index: Column, base: Column) -> Column:
    """The style of a character: the bits of the first run that holds it, over those of the style sheet."""
    holding = F.filter(runs, lambda r: (index >= r["start"]) & (index < r["end"]))
    return F.coalesce(F.try_element_at(holding, F.lit(1))["style"], F.lit(0)).bitwiseOR(base)


def rescaled(value: Column, old: int, new: int) -> Column:
    """A margin on a canvas of another size, rounded half to even."""
    return F.bround(value * F.lit(new / old)).cast("int")


def ass_color(text: Column, alpha_level: Column | int = 0) -> Column:
    """RRGGBBAA of an ASS colour (``&HAABBGGRR&``, ``&HBBGGRR&`` or a decimal BGR value); null when it is none.

    The level is the transparency of a colour that names none.
    """
    t = F.upper(F.regexp_replace(F.trim(text), r"^&+|&+$", ""))
    digits = F.nullif(F.regexp_extract(t, r"^H([0-9A-F]{1,8})$", 1), F.lit(""))
    decimal = F.when(F.rlike(t, F.lit(r"^\d{1,10}$")), t.cast("long"))
    value = F.coalesce(F.conv(digits, 16, 10).cast("long"), decimal)
    level = alpha_level if isinstance(alpha_level, Column) else F.lit(alpha_level)
    clear = F.when(F.length(digits) > 6, F.shiftright(value, 24).bitwiseAND(F.lit(255))).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), level)))
    part = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    byte = lambda n: part(F.shiftright(value, n).bitwiseAND(F.lit(255)))
    return F.concat(byte(0), byte(8), byte(16), part(255 - clear))


def to_ass_color(rgba: Column) -> Column:
    """``&HAABBGGRR`` of RRGGBBAA."""
    pair = lambda n: F.substring(rgba, n, 2)
    return F.concat(F.lit("&H"), F.lpad(F.hex(255 - F.conv(pair(7), 16, 10).cast("long")), 2, "0"), pair(5), pair(3), pair(1))


def from_legacy_alignment(legacy: Column) -> Column:
    """SSA's alignment (1 to 3 bottom, 4 more at the top, 8 more in the middle) as a keypad digit; anything else is 2."""
    return F.when(legacy.between(1, 3), legacy).when(legacy.between(5, 7), legacy + 2).when(legacy.between(9, 11), legacy - 5).otherwise(2)


def to_legacy_alignment(keypad: Column) -> Column:
    return F.when(keypad >= 7, keypad - 2).when(keypad >= 4, keypad + 5).otherwise(keypad)
