"""Registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest_neighbours
from .common import table
from .dual_tree import ranked_search
from .exact_dedup import exact_dedup
from .html_extract import main_text
from .langid import language_id
from .merkle import merkle_manifest, verification_digests, without_line_ends
from .mixing import mix_sources
from .packing import pack_documents
from .piece_table import encode_texts, encoding_digests
from .pii import find_personal_data, span_digests
from .simhash import simhash_groups
from .suffix_dedup import removal_digests, remove_repeats
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed once, sources weighted by the root of their size."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix.*")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_personal_data(table(spark, sf_dir, "documents")))


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(remove_repeats(table(spark, sf_dir, "documents")))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(encode_texts(table(spark, sf_dir, "documents"), decoded=True))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification_digests(merkle_manifest(table(spark, sf_dir, "documents"), presented=without_line_ends()))


def queries() -> dict[str, Query]:
    fns = (
        op1_token_counts,
        op2_mix_sources,
        op3_personal_data,
        op4_remove_repeats,
        op5_simhash_groups,
        op6_language_id,
        op7_main_text,
        op8_exact_dedup,
        op9_pack_documents,
        op10_nearest_neighbours,
        op11_sentencepiece,
        op12_lexical_search,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in fns}
