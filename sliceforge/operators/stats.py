"""Per-document statistics and nested chunk lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceforge.functions.text import byte_size, char_count, line_count, md5_hex
from sliceforge.operators.chunker import chunk_id


def document_stats(text: Column) -> list[Column]:
    """P5: total_chars, total_lines, file_size, md5_hash of the normalised text."""
    return [
        char_count(text).cast("int").alias("total_chars"),
        line_count(text).cast("int").alias("total_lines"),
        byte_size(text).cast("bigint").alias("file_size"),
        md5_hex(text).alias("md5_hash"),
    ]


def chunk_info_list(meta: Column, doc_id: Column, created_at: Column) -> Column:
    """A2: the ordered ``ChunkInfo`` list of a document (no chunk text)."""
    return F.transform(
        meta,
        lambda c: F.struct(
            chunk_id(doc_id, c["number"]).alias("id"),
            c["number"].alias("number"),
            c["tokens"].alias("tokens"),
            doc_id.cast("string").alias("doc_id"),
            c["content_hash"].alias("content_hash"),
            c["character_count"].alias("character_count"),
            created_at.alias("created_at"),
        ),
    )


def chunk_id_list(meta: Column, doc_id: Column) -> Column:
    """A10: chunk ids of a document in number order."""
    return F.transform(meta, lambda c: chunk_id(doc_id, c["number"]))


def model_limits(spark, model_name: str, factor: float):
    """S10 / P1 as a table: the model registry with the limit for ``factor``."""
    from sliceforge.config import MODEL_CONFIGS, validate_factor

    rows = [(m, int(c["tokens"]), c["encoding"]) for m, c in MODEL_CONFIGS.items()]
    reg = spark.createDataFrame(rows, "model_name string, tokens int, encoding string")
    return reg.withColumn("token_limit", (F.col("tokens") * F.lit(validate_factor(factor))).cast("int"))


def with_model_limit(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach model name and token limit to every document.

    The registry is a fixed six-row table, so broadcasting it is size-bounded.
    """
    return docs.join(F.broadcast(registry.select("model_name", "token_limit")), on="model_name", how="left")
