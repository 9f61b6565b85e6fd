"""Rules on single glyphs, and how glyphs and lines are written as drawing operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import values

_CATEGORIES = "".join(rf"\p{{{c}}}" for c in values.FORMULA_CATEGORIES)
FORMULA_CHAR = rf"^[{_CATEGORIES}\x{{{values.GREEK[0]:x}}}-\x{{{values.GREEK[1]:x}}}]"


def font_suffix(font: Column) -> Column:
    """A font's name after its last plus sign."""
    return F.element_at(F.split(font, r"\+"), -1)


def formula_font(font: Column, pattern: str | None = None) -> Column:
    """By the user's pattern if there is one, else by the fixed list; from the first letter."""
    return font_suffix(font).rlike(f"^(?:{pattern or values.FORMULA_FONTS})")


def formula_char(ch: Column, pattern: str | None = None) -> Column:
    """By the user's pattern if there is one, else by category or block of the first code point."""
    if pattern:
        return ch.rlike(f"^(?:{pattern})")
    return (ch != " ") & ch.rlike(FORMULA_CHAR)


def is_formula_glyph(font: Column, ch: Column, font_pattern: str | None = None, char_pattern: str | None = None) -> Column:
    return ch.startswith("(cid:") | formula_font(font, font_pattern) | formula_char(ch, char_pattern)


def vertical(a: Column, d: Column) -> Column:
    return (a == 0) & (d == 0)


def modifier(ch: Column) -> Column:
    """Letter modifiers, marks and symbols that take no advance of their own."""
    return ch.rlike("^[" + "".join(rf"\p{{{c}}}" for c in values.MODIFIER_CATEGORIES) + "]")


def _hex(number: Column, width: int) -> Column:
    h = F.lower(F.hex(number))
    return F.when(F.length(h) >= width, h).otherwise(F.lpad(h, width, "0"))


def code_points(text: Column) -> Column:
    """Code points of a text in order: four bytes each in UTF-32."""
    wide = F.hex(F.encode(text, "UTF-32"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda k: F.conv(F.substring(wide, 8 * k + 1, F.lit(8)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def encoded(text: Column, wide: Column) -> Column:
    """A text as hexadecimal codes: four digits each in a wide font, else two."""
    return F.array_join(F.transform(code_points(text), lambda c: F.when(wide, _hex(c, 4)).otherwise(_hex(c, 2))), "")


def text_op(font: Column, size: Column, x: Column, y: Column, codes: Column) -> Column:
    return F.format_string(values.TEXT_OPERATOR, font, size, x, y, codes)


def line_op(x: Column, y: Column, xlen: Column, ylen: Column, width: Column) -> Column:
    return F.format_string(values.LINE_OPERATOR, x, y, width, xlen, ylen)


def text_op_bytes(font: str, size: float, x: float, y: float, codes: str) -> str:
    """The same in Python, whose %f rounds ties as the format's writers do."""
    return values.TEXT_OPERATOR % (font, size, x, y, codes)


def line_op_bytes(x: float, y: float, xlen: float, ylen: float, width: float) -> str:
    return values.LINE_OPERATOR % (x, y, width, xlen, ylen)
