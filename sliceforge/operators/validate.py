"""Row validation and failure capture.

A bad document never stops the others: every check yields an ``error``
column instead of raising, and rejected rows travel on as data (failed
processing state, import summary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceforge.functions.text import is_blank, normalize_newlines
from sliceforge.functions.tokens import Counter

DECODE_ERROR = "'utf-8' codec can't decode the file: invalid UTF-8 byte sequence"


def decode_utf8(content: Column) -> tuple[Column, Column]:
    """Strict UTF-8 decode of raw bytes with newline normalisation.

    Returns ``(text, error)``; a byte-order mark is kept (codec ``utf-8``).
    """
    raw = content.cast("string")
    ok = F.is_valid_utf8(raw)
    text = F.when(ok, normalize_newlines(raw))
    error = F.when(~ok, F.lit(DECODE_ERROR))
    return text, error


def empty_error(text: Column, path: Column) -> Column:
    """``strip()`` empty -> ``File <path> is empty.``"""
    return F.when(text.isNull() | is_blank(text), F.format_string("File %s is empty.", path))


def no_chunks_error(chunks: Column, path: Column) -> Column:
    """Nothing left after splitting (e.g. ``"..."``)."""
    return F.when(F.size(chunks) == 0, F.format_string("No chunks created for file %s.", path))


def first_error(*errors: Column) -> Column:
    """The first check that fails, in pipeline order."""
    return F.coalesce(*errors)


def pre_chunk_error(df: DataFrame, counter: Counter) -> Column:
    """Errors known before chunking: decode, blank, special tokens."""
    decode = F.col("decode_error") if "decode_error" in df.columns else F.lit(None).cast("string")
    return first_error(decode, empty_error(F.col("text"), F.col("path")), counter.special_error(F.col("text")))
