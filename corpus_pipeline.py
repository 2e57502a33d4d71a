"""The training-data pipeline: stages over ``documents``, in order.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sliceforge.llm.exact_dedup import drop_exact_duplicates
from sliceforge.llm.langid import keep_identified
from sliceforge.llm.mixing import mix_sources, tempered_weights
from sliceforge.llm.packing import pack_documents
from sliceforge.llm.simhash import drop_near_duplicates
from sliceforge.session import ensure_checkpoint_dir, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts of which no language has three words in
    ten, go."""
    ship_package(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z, the row with the largest doc_id stays."""
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints (four-word shingles, at most
    four differing bits), the one of the smallest doc_id stays."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights (document counts to the power 0.8): smaller
    sources are repeated until the largest has been used up once, so every
    document stays and the mixture holds its weights to less than one block."""
    ship_package(spark)
    return mix_sources(docs, tempered_weights(docs, alpha=0.8), exhausted="repeat", out_col="__mix").drop("__mix")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

#: Language identification is a trained model: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{root}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
