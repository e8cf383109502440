"""Subtitle markup to styled text and back: ASS, WebVTT and timed text samples, beside SubRip in ``styles``.

Styled text is (text, runs): runs are sorted, do not touch with equal styles, and hold a bit mask each (``styles.BOLD`` ...).
``normal_runs`` brings any runs into that form: it cuts the text at all ends, joins the bits of the runs above each
piece and merges equal neighbours.  Writers open and close tags at a run's ends, inner tags first.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.functions.styles import _RUNS, BOLD, ITALIC, STRIKEOUT, UNDERLINE

_RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "style")])
STYLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("alignment", T.IntegerType())])
#: Entities that WebVTT text may hold.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "nbsp": " ", "lrm": "‎", "rlm": "‏", "quot": '"', "apos": "'"}


def _last(c: Column, pattern: str) -> Column:
    """The first group of the last match."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def appended(s: Column, piece: Column) -> tuple[Column, Column]:
    """(text, runs) of a state with ``piece`` behind its text in its style."""
    at = F.length(s["text"])
    last = F.try_element_at(s["runs"], F.lit(-1))
    joins = F.coalesce((last["end"] == at) & (last["style"] == s["style"]), F.lit(False))
    run = F.array(F.struct(F.when(joins, last["start"]).otherwise(at).alias("start"), (at + F.length(piece)).alias("end"), s["style"].alias("style")))
    before = F.when(joins, F.slice(s["runs"], 1, F.greatest(F.size(s["runs"]) - 1, F.lit(0)))).otherwise(s["runs"])
    plain = (s["style"] == 0) | (F.length(piece) == 0)
    return F.concat(s["text"], piece), F.when(plain, s["runs"]).otherwise(F.concat(before, run).cast(_RUNS))


def ass_styled(markup: Column) -> Column:
    """(text, runs, alignment) of an event's text: the last of each override in a block counts, ``\\r`` drops all before it, ``\\p`` hides drawings.

    ``\\N`` and ``\\n`` break the line, ``\\h`` is a hard blank, a block without overrides is a comment.
    """
    tokens = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?s)\{[^}]*\}|\\[Nnh]|[^{\\]+|[{\\]"), F.lit(0))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("style"), F.array().cast(_RUNS).alias("runs"), F.lit(False).alias("drawing"), F.lit(2).alias("alignment"))

    def step(s: Column, t: Column) -> Column:
        block = F.rlike(t, F.lit(r"(?s)^\{.*\\.*\}$"))
        comment = F.rlike(t, F.lit(r"(?s)^\{.*\}$"))
        tags = F.regexp_replace(t, r"(?s)^.*\\r[^\\}]*", "")
        style = F.when(F.rlike(t, F.lit(r"\\r")), F.lit(0)).otherwise(s["style"])
        weight = _last(tags, r"\\b(\d+)").cast("int")
        for bit, on in ((BOLD, (weight == 1) | (weight >= 600)), *((bit, _last(tags, rf"\\{key}([01])(?=[\\}}])") == "1") for bit, key in ((ITALIC, "i"), (UNDERLINE, "u"), (STRIKEOUT, "s")))):
            style = F.when(on, style.bitwiseOR(F.lit(bit))).when(~on, style.bitwiseAND(F.lit(15 - bit))).otherwise(style)
        piece = F.when(t.isin("\\N", "\\n"), "\n").when(t == "\\h", " ").otherwise(t)
        text, runs = appended(s, piece)
        kept = ~comment & ~s["drawing"]
        shape = _last(t, r"\\p(\d+)").cast("int")
        digit, legacy = _last(t, r"\\an([1-9])(?=[\\}])").cast("int"), _last(t, r"\\a(\d+)").cast("int")
        old = F.when(legacy.between(1, 3), legacy).when(legacy.between(5, 7), legacy + 2).when(legacy.between(9, 11), legacy - 5)
        return F.struct(
            F.when(kept, text).otherwise(s["text"]).alias("text"), F.when(block, style).otherwise(s["style"]).alias("style"), F.when(kept, runs).otherwise(s["runs"]).alias("runs"),
            F.when(block & shape.isNotNull(), shape > 0).otherwise(s["drawing"]).alias("drawing"), F.when(block, F.coalesce(digit, old, s["alignment"])).otherwise(s["alignment"]).alias("alignment"),
        )

    folded = F.aggregate(tokens, start, step)
    return F.struct(folded["text"].alias("text"), folded["runs"].alias("runs"), folded["alignment"].alias("alignment"))


def vtt_styled(markup: Column) -> Column:
    """(text, runs, alignment) of a WebVTT cue: each opening tag begins a scope that the next closing one ends, whatever their names.

    Times, classes, voices and ``ruby`` leave no mark, text of ``rt`` is dropped, and entities are decoded.
    """
    plain = F.regexp_replace(F.coalesce(markup, F.lit("")), "\r\n", "\n")
    tokens = F.regexp_extract_all(plain, F.lit(r"(?s)<[^>]*>|&\w{1,7};|[^<&]+|[<&]"), F.lit(0))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("style"), F.array().cast(_RUNS).alias("runs"), F.array().cast("array<int>").alias("scopes"), F.lit(0).alias("ruby"))
    table = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)])

    def step(s: Column, t: Column) -> Column:
        tag = F.rlike(t, F.lit(r"(?s)^<.*>$"))
        inner = F.trim(F.regexp_extract(t, r"(?s)^<(.*)>$", 1))
        closing = tag & inner.startswith("/")
        name = F.lower(F.regexp_extract(inner, r"^/?\s*([^\s.]*)", 1))
        unseen = F.rlike(inner, F.lit(r"^\d")) | (inner == "") | name.isin("ruby", "rt")
        opening = tag & ~closing & ~unseen
        bit = F.when(name == "b", BOLD).when(name == "i", ITALIC).when(name == "u", UNDERLINE).otherwise(0)
        pops = closing & ~name.isin("ruby", "rt") & (F.size(s["scopes"]) > 0)
        style = F.when(opening, s["style"].bitwiseOR(bit)).when(pops, F.try_element_at(s["scopes"], F.lit(-1))).otherwise(s["style"])
        scopes = F.when(opening, F.concat(s["scopes"], F.array(s["style"]))).when(pops, F.slice(s["scopes"], 1, F.greatest(F.size(s["scopes"]) - 1, F.lit(0)))).otherwise(s["scopes"])
        ruby = F.when(tag & (name == "rt"), F.when(closing, F.greatest(s["ruby"] - 1, F.lit(0))).otherwise(s["ruby"] + 1)).otherwise(s["ruby"])
        text, runs = appended(s, F.coalesce(F.try_element_at(table, t), t))
        kept = ~tag & (s["ruby"] == 0)
        return F.struct(F.when(kept, text).otherwise(s["text"]).alias("text"), style.alias("style"), F.when(kept, runs).otherwise(s["runs"]).alias("runs"), scopes.alias("scopes"), ruby.alias("ruby"))

    folded = F.aggregate(tokens, start, step)
    return F.struct(folded["text"].alias("text"), folded["runs"].alias("runs"), F.lit(2).alias("alignment"))


def normal_runs(runs: Column) -> Column:
    """Sorted runs that neither overlap nor touch with equal styles; where runs overlap, their bits are joined."""
    ends = F.array_sort(F.array_distinct(F.concat(F.transform(runs, lambda r: r["start"]), F.transform(runs, lambda r: r["end"]))))
    pieces = F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("start"), F.get(ends, i + 1).alias("end"), F.aggregate(F.filter(runs, lambda r: (r["start"] <= a) & (r["end"] > a)), F.lit(0), lambda x, r: x.bitwiseOR(r["style"])).alias("style")))

    def merge(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce((last["end"] == r["start"]) & (last["style"] == r["style"]), F.lit(False))
        grown = F.array(F.struct(F.when(joins, last["start"]).otherwise(r["start"]).alias("start"), r["end"].alias("end"), r["style"].alias("style")))
        return F.concat(F.when(joins, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done), grown).cast(_RUNS)

    return F.aggregate(F.filter(pieces, lambda r: r["style"] != 0), F.array().cast(_RUNS), merge)


def _rendered(text: Column, runs: Column, opening: dict[int, str], closing: dict[int, str], escape) -> Column:
    """Text with marks around its runs."""
    part = lambda a, b: escape(F.substring(text, a + 1, b - a))
    marks = lambda style, table: F.concat(*[F.when(style.bitwiseAND(F.lit(bit)) != 0, F.lit(mark)).otherwise(F.lit("")) for bit, mark in table.items()])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, r: F.struct(F.concat(s["out"], part(s["at"], r["start"]), marks(r["style"], opening), part(r["start"], r["end"]), marks(r["style"], closing)).alias("out"), r["end"].alias("at"))
    folded = F.aggregate(runs, start, step)
    return F.concat(folded["out"], part(folded["at"], F.length(text)))


def _tags(names: dict[int, str]) -> tuple[dict[int, str], dict[int, str]]:
    return {bit: f"<{n}>" for bit, n in names.items()}, {bit: f"</{n}>" for bit, n in reversed(names.items())}


def to_srt_markup(text: Column, runs: Column) -> Column:
    return _rendered(text, runs, *_tags({BOLD: "b", ITALIC: "i", UNDERLINE: "u", STRIKEOUT: "s"}), lambda c: c)


def to_vtt_markup(text: Column, runs: Column) -> Column:
    """WebVTT has no mark for struck text."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _rendered(text, runs, *_tags({BOLD: "b", ITALIC: "i", UNDERLINE: "u"}), safe)


def to_ass_markup(text: Column, runs: Column, alignment: Column | None = None) -> Column:
    keys = {BOLD: "b", ITALIC: "i", UNDERLINE: "u", STRIKEOUT: "s"}
    safe = lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("\\N")), F.lit(" "), F.lit("\\h"))
    body = _rendered(text, runs, {b: f"{{\\{k}1}}" for b, k in keys.items()}, {b: f"{{\\{k}0}}" for b, k in keys.items()}, safe)
    return body if alignment is None else F.concat(F.when(alignment != 2, F.concat(F.lit("{\\an"), alignment.cast("string"), F.lit("}"))).otherwise(F.lit("")), body)


def to_tx3g(text: Column, runs: Column, size: int = 18) -> Column:
    """A timed text sample: the text behind its length, and a box of style records where there are runs (no struck text there)."""
    raw = F.encode(text, "UTF-8")
    u16 = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    kept = F.filter(runs, lambda r: r["style"].bitwiseAND(F.lit(7)) != 0)
    records = F.aggregate(kept, F.lit(b""), lambda a, r: F.concat(a, u16(r["start"]), u16(r["end"]), F.lit(b"\0\1"), F.unhex(F.lpad(F.hex(r["style"].bitwiseAND(F.lit(7))), 2, "0")), F.lit(bytes([size]) + b"\xff" * 4)))
    n = F.size(kept)
    box = F.when(n > 0, F.concat(F.unhex(F.lpad(F.hex(10 + 12 * n), 8, "0")), F.lit(b"styl"), u16(n), records)).otherwise(F.lit(b""))
    return F.concat(u16(F.octet_length(raw)), raw, box)


@F.pandas_udf(STYLED)
def tx3g_styled(samples: pd.Series) -> pd.DataFrame:
    """(text, runs, alignment) of timed text samples; records without a style, or beyond the text, give no run."""
    rows = []
    for data in samples:
        data = bytes(data) if data is not None else b""
        size = min(int.from_bytes(data[:2]), max(0, len(data) - 2))
        raw, at, runs = data[2 : 2 + size], 2 + size, []
        text = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw[2:].decode("utf-16-le", "replace") if raw[:2] == b"\xff\xfe" else raw.decode("utf-8", "replace")
        while at + 8 <= len(data):
            (n, kind) = struct.unpack_from(">I4s", data, at)
            if n < 8 or at + n > len(data):
                break
            if kind == b"styl" and n >= 10:
                for i in range(min(int.from_bytes(data[at + 8 : at + 10]), (n - 10) // 12)):
                    start, end, _, face = struct.unpack_from(">HHHB", data, at + 10 + 12 * i)
                    if face & 7 and start < min(end, len(text)):
                        runs.append({"start": start, "end": min(end, len(text)), "style": face & 7})
            at += n
        rows.append({"text": text, "runs": runs, "alignment": 2})
    return pd.DataFrame(rows, columns=["text", "runs", "alignment"])
