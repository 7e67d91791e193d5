"""Scalar columns: text clean-up, loose number parsing, half-up rounding, bit strings, escaping.

All are built-in expressions.  A null input gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space, wide and zero-width ones included.
WS = r"[\s   -     　﻿]"


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def bare_text(text: Column) -> Column:
    """Lower case without white space and the common punctuation of both languages; null gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), WS + "|[，。；：,.!?！？、]", ""))


def ocr_text(text: Column) -> Column:
    """OCR output made uniform: slashes, quotes and colons in one form, blanks squeezed, lower case."""
    same = F.translate(F.coalesce(text, F.lit("")), "\\｜“”‘’`：", "//\"\"''':")
    return F.lower(squeeze(same))


def slug(text: Column, longest: int = 120, fallback: str = "item") -> Column:
    """A file-name-safe form."""
    s = F.regexp_replace(F.trim(text), r'[\\/:*?"<>|]+', "_")
    s = F.regexp_replace(F.regexp_replace(s, f"{WS}+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.substring(s, 1, longest), F.lit("")), F.lit(fallback))


def html_text(html: Column) -> Column:
    """Readable text of HTML: scripts, styles and tags to a blank, block ends to line breaks, entities decoded in
    the order below, blanks and empty lines squeezed, ends trimmed.  A null gives ''."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style).*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)</(?:h[1-6]|p|div|li|tr|pre|code)>|<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, f"^{WS}+|{WS}+$", "")


def cleaned_comment(html: Column, longest: int = 500) -> Column:
    """:func:`html_text` without replacement characters, blanks within lines squeezed, cut to ``longest``."""
    inner = WS.replace(r"\s", r"\t\f ")
    s = F.regexp_replace(F.replace(html_text(html), F.lit("\ufffd"), F.lit("")), f"{inner}+", " ")
    return F.substring(F.regexp_replace(s, f"^{WS}+|{WS}+$", ""), 1, longest)


def metric(name: str, places: int = 4) -> Column:
    """A number as text with at most ``places`` places, closing zeros left out; '' for none."""
    x = F.col(name)
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", x), "0+$", ""), r"\.$", "")
    return F.when(x.isNull() | F.isnan(x), "").otherwise(text)


def html_escape(text: Column) -> Column:
    s = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading quote; null gives ''."""
    c = F.coalesce(cell, F.lit(""))
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def ngrams(text: Column, n: int = 3) -> Column:
    """The set of character n-grams; empty for shorter texts."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def between(text: Column, starts: list[str], ends: list[str]) -> Column:
    """What lies between the earliest start marker and the earliest end marker after it; null without a start."""
    first = F.array_min(F.filter(F.array(*[F.struct(F.locate(m, text).alias("at"), F.lit(len(m)).alias("n")) for m in starts]), lambda x: x["at"] > 0))
    rest = F.substring(text, first["at"] + first["n"], F.length(text))
    last = F.array_min(F.filter(F.array(*[F.locate(m, rest) for m in ends]), lambda x: x > 0))
    return F.trim(F.when(last.isNull(), rest).otherwise(F.substring(rest, F.lit(1), last - 1)))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def number(text: Column) -> Column:
    """The text as a number; '' and junk give 0."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, null where it begins with none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded half towards plus infinity."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, most: float) -> Column:
    """Rounded half up into 0..most; null gives 0."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.floor(F.coalesce(x, F.lit(0.0)) + 0.5).cast("double")))


# Chinese digits.
DIGITS = "一二三四五六七八九"


def chinese_number(text: Column) -> Column:
    """A Chinese numeral up to 99 as a whole number; 999 for anything else."""

    at = F.locate("十", text)
    before, after = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)

    def value(c: Column) -> Column:
        return F.array_position(F.array(*[F.lit(d) for d in DIGITS]), c).cast("int")

    tens = F.when(before == "", 1).otherwise(F.nullif(value(before), F.lit(0)))
    ones = F.when(after == "", 0).otherwise(F.nullif(value(after), F.lit(0)))
    plain = F.nullif(value(text), F.lit(0))
    return F.coalesce(F.when(at > 0, tens * 10 + ones).otherwise(plain), F.lit(999)).cast("int")


def bits(text: Column) -> Column:
    """A string of 64 zeros and ones as a whole number with the same bits; null for anything else."""
    high = F.conv(F.substring(text, 1, 32), 2, 10).cast("long")
    low = F.conv(F.substring(text, 33, 32), 2, 10).cast("long")
    return F.when(text.rlike("^[01]{64}$"), F.shiftleft(high, 32).bitwiseOR(low))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def json_object(text: Column) -> Column:
    """The JSON object in a reply: the whole text, a fenced block, or from the first brace to the last;
    null where none parses."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.when(F.get_json_object(c, "$").startswith("{"), F.get_json_object(c, "$")) for c in (F.trim(text), fence, braces)]
    return F.coalesce(*tries)


def mime_of(name: Column) -> Column:
    """The image type that a file name's extension tells."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "webp", "gif", "bmp"), F.concat(F.lit("image/"), ext))


def magic_mime(content: Column) -> Column:
    """The image type that a file's first bytes tell."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("474946"), "image/gif")
        .when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    )
