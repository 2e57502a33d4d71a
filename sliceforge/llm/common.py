"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text_col: str) -> F.Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def ascii_lower(col: F.Column) -> F.Column:
    """``col`` with A-Z lowered and every other character kept.

    ``lower`` is much faster than ``translate`` but folds other letters too, so
    it is used only where the text has none but ASCII characters.
    """
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def slices(texts: list[str], max_chars: int):
    """Index ranges of ``texts`` of about ``max_chars`` characters each (one
    longer text is a range of its own): bounds the memory of a batch."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > max_chars:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose result has been written.

    Its cleaner acts when the driver's heap is collected, which in a job of few
    objects may be long after the step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
