"""String functions of the metadata layer, as Column expressions evaluated in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def strip(c: Column) -> Column:
    """Trim all whitespace, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_html(c: Column) -> Column:
    """Breaks and paragraph ends become line breaks, other tags go, the common entities are decoded."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return strip(c)


def clean_names(names: Column) -> Column:
    """Trimmed, non-blank, distinct in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def joined_names(names: Column) -> Column:
    return F.nullif(F.array_join(clean_names(names), ", "), F.lit(""))


def _unaccented() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and the base letters; made by Unicode's rule."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTS = _unaccented()


def normal_title(c: Column) -> Column:
    """Lower case, accents and marks dropped, ``&`` spelt out, everything else but letters and digits one space."""
    c = F.lower(F.regexp_replace(F.translate(c, *ACCENTS), r"\p{Mn}", ""))
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", " "))


def same_title(a: Column, b: Column) -> Column:
    """Equal after normalisation and a leading article; empty titles are never the same."""
    key = lambda c: F.regexp_replace(normal_title(c), "^the ", "")
    return (key(a) == key(b)) & (F.length(key(a)) > 0)


_TOKEN = re.compile(r"\{([^{}|:]+)(?::([^{}|]*))?(?:\|([a-z]+))?\}")


def template(pattern: str, columns: dict[str, Column]) -> Column:
    """``{Token}`` substitution; null if any token is null or blank."""
    parts, at = [], 0
    for m in _TOKEN.finditer(pattern):
        parts += [F.lit(pattern[at : m.start()]), blank_to_null(columns.get(m[1], F.lit(None)).cast("string"))]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def _words(c: Column) -> Column:
    return F.split(strip(c), r"\s+")


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


TRANSFORMS = {
    "upper": F.upper,
    "lower": F.lower,
    "capitalize": lambda c: F.array_join(F.transform(_words(c), _capital), " "),
    "snake": lambda c: F.lower(F.array_join(_words(c), "_")),
    "train": lambda c: F.array_join(F.transform(_words(c), _capital), "-"),
    "dot": lambda c: F.array_join(_words(c), "."),
    "camel": lambda c: F.array_join(F.transform(_words(c), lambda x, i: F.when(i == 0, F.lower(x)).otherwise(_capital(x))), ""),
}


def _formatted(value: Column, form: str) -> Column:
    """A number padded with zeros, or a part of an ISO date."""
    if set(form) == {"0"}:
        return F.when(F.length(value) < len(form), F.lpad(value, len(form), "0")).otherwise(value)
    short = F.when((F.length(value) >= 4) & F.lit(form == "yyyy"), F.substring(value, 1, 4)).otherwise(value)
    return F.coalesce(F.date_format(F.try_to_timestamp(value), form), short)


def name_format(pattern: str, columns: dict[str, Column]) -> Column:
    """``{Tag:000|transform}`` or ``{Tag:yyyy}``: blanks for missing tags, null only when all tags are missing."""
    parts, found, at = [], [], 0
    for m in _TOKEN.finditer(pattern):
        value = blank_to_null(columns.get(m[1], F.lit(None)).cast("string"))
        found.append(value.isNotNull())
        if m[2]:
            value = _formatted(value, m[2])
        if m[3]:
            value = TRANSFORMS[m[3]](value)
        parts += [F.lit(pattern[at : m.start()]), F.coalesce(value, F.lit(""))]
        at = m.end()
    any_found = found[0]
    for x in found[1:]:
        any_found = any_found | x
    return F.when(any_found, sanitize(F.concat(*parts, F.lit(pattern[at:]))))


def sanitize(c: Column) -> Column:
    """A safe file name: separators become dashes, forbidden and control characters go, blanks collapse."""
    c = F.regexp_replace(c, r"[/\\]", "-")
    c = F.regexp_replace(c, r'[<>:"|?*\x00-\x1F]', "")
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"[. ]+$", "")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def redact(url: Column, names: tuple[str, ...] = ("api_key", "apikey", "token")) -> Column:
    """Hide secret query parameters."""
    return F.regexp_replace(url, rf"(?i)([?&](?:{'|'.join(names)})=)[^&]*", "$1***")


def hd_class(width: Column, height: Column, *, detect_4k: bool = False) -> Column:
    """0 below 1280 wide and 720 high, 1 up to 1280x720, 2 full HD up to 1920x1088, 3 beyond (2 unless 4K is told apart)."""
    beyond = F.when((width > 1920) | (height > 1088), 3 if detect_4k else 2)
    return beyond.when((width > 1280) | (height > 720), 2).when((width >= 1280) | (height >= 720), 1).otherwise(0).cast("int")


def channel_name(channels: Column) -> Column:
    names = {1: "Mono", 2: "Stereo", 6: "5.1", 8: "7.1"}
    out = F.concat(channels.cast("string"), F.lit(" ch"))
    for n, name in names.items():
        out = F.when(channels == n, name).otherwise(out)
    return out


def _fixed_line(c: Column) -> Column:
    """Words of a line that recognition misreads: a lone l, its contractions, an inner capital I, an l before capitals."""
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}'])l(?![\p{L}\p{N}'])", "I")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}])l'(m|ll|ve|d)(?!\p{L})", "I'$1")
    c = F.regexp_replace(c, r"(?<!\p{L})([\p{L}&&[^\p{Lu}]]*\p{Ll})I(\p{Ll}[\p{L}&&[^\p{Lu}]]*)(?!\p{L})", "$1l$2")
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}])l(?=\p{Lu}[\p{Lu}']*(?!\p{L}))", "I")


#: Characters that recognition gives for others, and what they stand for.
OCR_CHARACTERS = {"|": "I", "‘": "'", "’": "'", "ʼ": "'", "′": "'", "“": '"', "”": '"', "″": '"', " ": " ", " ": " ", " ": " "}


def clean_ocr(c: Column) -> Column:
    """Recognised subtitles with plain quotes, trimmed lines, no specks, the usual misreadings mended, and music notes around sung lines."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?|\f|\x0B", "\n")
    plain = F.translate(plain, "".join(OCR_CHARACTERS), "".join(OCR_CHARACTERS.values()))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t　]+", " ")))
    lines = F.filter(lines, lambda x: (x != "") & ~((F.length(x) <= 2) & ~F.rlike(x, F.lit(r"[\p{L}\p{N}]"))))
    text, note = F.array_join(F.transform(lines, _fixed_line), "\n"), F.lit("♪")
    lone = F.rlike(text, F.lit(r"(?s)^. .* .$")) & F.rlike(text, F.lit(r"(?s)^J.*[JI\[\]'SsNf]$|^[JI\[\]'SsNf].*J$"))
    framed = lone & (text.contains("\n") | F.rlike(text, F.lit(r"^\S+ .+ \S+$")))
    return F.when(framed, F.concat(note, F.substring(text, F.lit(2), F.length(text) - 2), note)).otherwise(text)


#: Fixed values: (tag, three-letter code, English name) of languages that suffixes of file names tell.
LANGUAGE_NAMES = [
    ("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("es", "spa", "Spanish"), ("it", "ita", "Italian"), ("pt", "por", "Portuguese"),
    ("nl", "nld", "Dutch"), ("sv", "swe", "Swedish"), ("ru", "rus", "Russian"), ("ja", "jpn", "Japanese"), ("ko", "kor", "Korean"), ("zh", "zho", "Chinese"),
]


def language_from_name(suffix: Column, languages: list[tuple[str, str, str]] = LANGUAGE_NAMES) -> Column:
    """The tag of the first part of a name's suffix (``.fr``, ``_eng``, ``English``) that is a language's code or name."""
    known: list[Column] = []
    for tag, code, name in languages:
        for key in (tag, code, name.lower()):
            known += [F.lit(key), F.lit(tag)]
    table = F.create_map(*known)
    parts = F.transform(F.split(suffix, r"[._\- ]"), lambda x: F.try_element_at(table, F.lower(x)))
    return F.try_element_at(F.filter(parts, lambda x: x.isNotNull()), F.lit(1))
