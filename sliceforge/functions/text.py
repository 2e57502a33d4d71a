"""Text scalars as Spark Column expressions (S4, P3, P5 and section 2.10).

Python's ``str.strip()`` / ``str.isspace()`` use a wider white-space set than
Spark's ``trim`` (space only) or the bare ``\\s`` of Java / RE2, so the set is
spelled out once here and rendered for each engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python treats as white space, as ranges.
PY_WHITESPACE_RANGES: tuple[tuple[int, int], ...] = (
    (0x0009, 0x000D),
    (0x001C, 0x0020),
    (0x0085, 0x0085),
    (0x00A0, 0x00A0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

WS_CHARS: str = "".join(chr(c) for lo, hi in PY_WHITESPACE_RANGES for c in range(lo, hi + 1))


def _render_class(fmt) -> str:
    return "".join(fmt(lo) if lo == hi else f"{fmt(lo)}-{fmt(hi)}" for lo, hi in PY_WHITESPACE_RANGES)


# Body of a character class (no brackets) for Java / RE2 (``\x{..}``) and for
# Python's ``regex`` module (``\uXXXX``).
WS_CLASS_JAVA: str = _render_class(lambda c: "\\x{%X}" % c)
WS_CLASS_PY: str = _render_class(lambda c: "\\u%04X" % c)


def ws_chars_sql() -> str:
    """The white-space set as a DuckDB string expression built from ``chr``."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def normalize_newlines(text: Column) -> Column:
    """Text-mode read: ``\\r\\n`` and lone ``\\r`` become ``\\n`` (two literal
    replacements, no regex)."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def py_strip(text: Column) -> Column:
    """``str.strip()``: remove Python white space at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """``not text.strip()``: no character outside the white-space set.  A regex
    search stops at the first such character instead of copying the text."""
    return ~text.rlike(f"[^{WS_CLASS_JAVA}]")


def line_count(text: Column) -> Column:
    """``text.count('\\n') + 1``."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) + F.lit(1)


def char_count(text: Column) -> Column:
    """Number of code points (Python ``len``)."""
    return F.char_length(text)


def byte_size(text: Column) -> Column:
    """UTF-8 length of the (normalised) text."""
    return F.octet_length(text)


def md5_hex(text: Column) -> Column:
    """Lower-case hex MD5 of the UTF-8 bytes."""
    return F.md5(text)
