"""Verification modes (J1-J5) on clean and corrupted stores."""

from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.operators.verify import corrupt_chunks, verify_documents
from sliceforge.plans.import_job import chunks_table, document_info_table, prepare
from sliceforge.session import materialize
from sliceforge.sources.corpus import corpus_from_table

from .conftest import SF_SMALL


def _import(spark):
    opts = ChunkOptions(factor=1 / 128)
    prepared = materialize(prepare(corpus_from_table(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), opts))
    return document_info_table(prepared, opts, "m"), chunks_table(prepared, opts)


def test_clean_store_is_valid_in_every_mode(spark):
    info, chunks = _import(spark)
    for mode in ("strict", "lenient", "token"):
        res = verify_documents(info, chunks, mode)
        assert res.where(~F.col("is_valid")).count() == 0
        assert res.count() == info.count()


def test_corruptions_are_found(spark):
    info, chunks = _import(spark)
    bad = corrupt_chunks(chunks)
    strict = {r.doc_id: r.reason for r in verify_documents(info, bad, "strict").collect()}
    lenient = {r.doc_id: r.reason for r in verify_documents(info, bad, "lenient").collect()}
    token = {r.doc_id: r.reason for r in verify_documents(info, bad, "token").collect()}
    assert set(strict.values()) >= {None, "missing", "hash mismatch", "token mismatch"}
    # lenient only sees missing chunks, token additionally sees token totals
    assert {d for d, r in lenient.items() if r} <= {d for d, r in token.items() if r} <= {d for d, r in strict.items() if r}
    assert all(r in (None, "missing") for r in lenient.values())


def test_unknown_mode(spark):
    info, chunks = _import(spark)
    res = verify_documents(info, chunks, "paranoid")
    assert res.where(F.col("is_valid")).count() == 0
    assert {r.reason for r in res.collect()} == {"unknown mode"}


def test_bpe_recount_error_makes_document_invalid(spark):
    from sliceforge.functions.tokens import get_counter

    bpe = get_counter("bpe", encoding="byte_bpe_50k", on_special="error")
    info = spark.createDataFrame(
        [("d", 4, [("d-chunk-1", 1, 4, "d", "x", 5, None)])],
        "id string, total_tokens int, chunks array<struct<id:string,number:int,tokens:int,doc_id:string,"
        "content_hash:string,character_count:int,created_at:timestamp>>",
    )
    stored = spark.createDataFrame([("d-chunk-1", "d", "hi <|endoftext|>")], "id string, doc_id string, text string")
    res = verify_documents(info, stored, "strict", bpe).collect()
    assert [(r.is_valid, r.reason) for r in res] == [(False, "token mismatch")]


def _info(spark, rows):
    chunk = "struct<id:string,number:int,tokens:int,content_hash:string>"
    return spark.createDataFrame(rows, f"id string, total_tokens int, chunks array<{chunk}>")


def test_records_without_chunks_are_judged(spark):
    from sliceforge.operators.verify import verify_all_modes, verify_documents

    info = _info(spark, [("none", 0, []), ("null", None, None), ("claims", 5, []), ("gone", 2, [("gone-chunk-1", 1, 2, "x")])])
    stored = spark.createDataFrame([], "id string, doc_id string, text string")
    got = {r.doc_id: r[1:] for r in verify_all_modes(info, stored).collect()}
    total = "total mismatch"
    assert got == {
        "none": (None, None, None),
        "null": (None, None, None),
        "claims": (total, None, total),
        "gone": ("missing", "missing", "missing"),
    }
    assert {r.reason for r in verify_documents(info, stored, "no such mode").collect()} == {"unknown mode"}


def test_a_failed_recount_makes_the_total_wrong(spark):
    from sliceforge.functions.tokens import get_counter
    from sliceforge.operators.verify import verify_all_modes

    text, bad = "two tokens", "no <|endoftext|>"
    counter = get_counter("bpe", encoding="byte_bpe_50k")
    info = _info(spark, [("d", 2, [("d-chunk-1", 1, 2, "h"), ("d-chunk-2", 2, 0, "h")])])
    stored = spark.createDataFrame([("d-chunk-1", "d", text), ("d-chunk-2", "d", bad)], "id string, doc_id string, text string")
    row = verify_all_modes(info, stored, counter).first()
    assert (row.reason_lenient, row.reason_token) == (None, "total mismatch")


def test_records_are_verified_without_reading_their_texts(spark, tmp_out):
    import re

    from sliceforge.plans.catalog import queries

    from .conftest import SF_SMALL

    length = "spark.sql.maxMetadataStringLength"  # a plan's text cuts schemas at it
    before = spark.conf.get(length)
    spark.conf.set(length, "5000")
    try:
        plan = queries()["verify_strict_64"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(length, before)
    scans = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    assert len(scans) == 2 and sum("chunk_texts" in s for s in scans) == 1
