"""Exact deduplication by recipes of content-defined chunks (DataFrame functions only).

Every normalised text is cut where its own content says so, each chunk is
deduplicated to a verified identifier, and documents are compared by their
ordered lists of identifiers.  Chunks are shuffled as a 64-bit fingerprint and
a SHA-256 digest; the texts themselves stay in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import ascii_lower, release, whole_text

#: Chunk length bounds in characters; a chunk ends at the first place after
#: MIN_CHARS that looks like CUT, or at MAX_CHARS.  CUT is rare (one place in some
#: hundred characters of prose), so that an insertion shifts the cuts of its own
#: surroundings only.
MIN_CHARS = 256
MAX_CHARS = 4096
CUT = r"[d-p][a-e]\s(?=[a-f][e-t])"


def content_chunks(text: F.Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> F.Column:
    """Array of the chunks of ``text`` in order; their concatenation is the
    text.  The empty text has one empty chunk."""
    pattern = rf"(?s).{{{min_chars},{max_chars}}}?{CUT}|.{{1,{max_chars}}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)


def chunk_occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_sha256, pos, fp, digest), one row per chunk occurrence."""
    norm = df.select(F.col(id_col).alias("doc_id"), ascii_lower(whole_text(text_col)).alias("t"))
    return norm.select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"), F.posexplode(content_chunks(F.col("t"))).alias("pos", "chunk")
    ).select("doc_id", "text_sha256", "pos", F.xxhash64("chunk").alias("fp"), F.unhex(F.sha2("chunk", 256)).alias("digest"))


def chunk_dictionary(occurrences: DataFrame) -> DataFrame:
    """(fp, digest, nth): each distinct chunk once.  Chunks whose fingerprints
    collide differ in ``nth``, so (fp, nth) identifies a chunk's content."""
    distinct = occurrences.groupBy("fp", "digest").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("fp").orderBy("digest"))
    return distinct.select("fp", "digest", nth.alias("nth"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lowering A-Z only; of equal texts the
    row with the largest id stays.  Defined cases: a null text is the empty
    text; empty texts are equal to each other; rows that repeat id and text are
    members like any other and exactly one of them is kept; a null id is smaller
    than every id (a group of null ids only keeps one of its rows); texts of any
    length are read whole; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    occ = materialize(chunk_occurrences(df, id_col, text_col), "chunk-occurrences")
    named = occ.join(chunk_dictionary(occ), ["fp", "digest"])
    # Rows that repeat id and text bring the same chunks: collect_set folds them
    # and the first chunk counts them.
    recipes = named.groupBy("doc_id", "text_sha256").agg(
        F.count_if(F.col("pos") == 0).alias("copies"),
        F.transform(
            F.array_sort(F.collect_set(F.struct("pos", "fp", "nth"))), lambda c: F.struct(c["fp"].alias("fp"), c["nth"].alias("nth"))
        ).alias("recipe"),
    )
    recipes = recipes.select(
        "doc_id", "text_sha256", "copies", "recipe", F.xxhash64("recipe").alias("recipe_hash")
    )
    groups = recipes.groupBy("recipe_hash", "recipe").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    joined = recipes.join(groups, ["recipe_hash", "recipe"])
    rows = joined.select(
        "doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    # With null ids only, rows of a group agree in text but may differ in
    # nothing else, so the first copy stands for them.
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts (the one of the largest
    id), all its columns.  The kept ids are written first; then the texts move
    once, to meet them.  Rows that repeat id and text meet in the same task and
    one of them stays."""
    keys = ["__dedup_id", "__dedup_sha"]
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    keep = (
        exact_dedup(df, id_col, text_col)
        .filter("kept")
        .select(name(F.col("doc_id")).alias(keys[0]), F.col("text_sha256").alias(keys[1]))
    )
    keep = materialize(keep, "kept-documents")
    release(df.sparkSession)
    keyed = df.withColumn(keys[0], name(F.col(id_col))).withColumn(keys[1], F.sha2(ascii_lower(whole_text(text_col)), 256))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    stay = keyed.join(keep, keys, "left_semi").withColumn("__dedup_nth", nth).filter("__dedup_nth = 1")
    return stay.select(*[F.col(f"`{c}`") for c in df.columns])
