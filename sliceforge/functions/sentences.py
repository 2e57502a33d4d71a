"""Sentence splitters as Catalyst array expressions.

Each returns ``array<string>`` per row; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sliceforge.functions.text import WS_CLASS_JAVA, py_strip

# A run of sentence end marks followed by white space (or the end of the
# text), else the rest.  Pieces concatenate back to the input ("3.14" stays whole).
# A run is tried from its first mark only, and taken whole: linear on long runs.
LOSSLESS_PATTERN = rf"(?s).*?(?<![.!?])[.!?]++(?:[{WS_CLASS_JAVA}]+|\z)|.+"

# Split after an end mark at a run of white space.
PUNCT_SPLIT_PATTERN = rf"(?<=[.!?])[{WS_CLASS_JAVA}]+"


def _strip_nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, py_strip), lambda x: x != F.lit(""))


def split_dot(text: Column) -> Column:
    """Split on '.', strip, drop blanks, append '.' to every piece."""
    return F.transform(_strip_nonblank(F.split(text, r"\.", -1)), lambda x: F.concat(x, F.lit(".")))


def split_lossless(text: Column) -> Column:
    """Rule-based sentences *with* their trailing white space."""
    return F.regexp_extract_all(text, F.lit(LOSSLESS_PATTERN), 0)


def split_punct(text: Column) -> Column:
    """Split after [.!?] at white space; strip; drop blanks."""
    return _strip_nonblank(F.split(text, PUNCT_SPLIT_PATTERN, -1))


def split_words(text: Column) -> Column:
    """Python ``str.split()``: white-space runs, no blanks."""
    return F.filter(F.split(text, f"[{WS_CLASS_JAVA}]+", -1), lambda x: x != F.lit(""))


SPLITTERS = {"dot": split_dot, "lossless": split_lossless, "punct": split_punct}


def get_splitter(name: str):
    if name not in SPLITTERS:
        raise ValueError(f"unknown splitter {name!r}; choose from {', '.join(SPLITTERS)}")
    return SPLITTERS[name]
