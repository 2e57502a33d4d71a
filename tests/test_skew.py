"""A hot document: one row holding a third of the corpus text.

The chunker is narrow (the document is one row in one task either way), and
verification joins on the chunk id, so the hot document's chunks spread over
the join; results must equal the SQL formulation and both engines.
"""

import duckdb
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.operators.chunker import chunk_documents
from sliceforge.operators.verify import corrupt_chunks, verify_documents
from sliceforge.plans import oracle
from sliceforge.plans.import_job import chunks_table, document_info_table, prepare
from sliceforge.session import materialize
from sliceforge.sources.corpus import corpus_from_table

from .conftest import SF_SMALL


def _hot_corpus(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    hot = docs.agg(F.concat_ws("\n", F.collect_list("text")).alias("text")).select(F.lit(-1).cast("bigint").alias("doc_id"), "text")
    return docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100000)).unionByName(hot)


def test_hot_document_chunks_match_sql(spark):
    corpus = _hot_corpus(spark).cache()
    flat = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    a = chunk_documents(flat, 64, "regex").select("doc_id", "number", "tokens", "content_hash")
    b = chunk_documents(flat, 64, "regex", engine="catalyst").select("doc_id", "number", "tokens", "content_hash")
    got = sorted(tuple(r) for r in a.collect())
    assert got == sorted(tuple(r) for r in b.collect())
    con = duckdb.connect()
    con.register("documents_df", corpus.toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM documents_df")
    want = sorted(tuple(r) for r in con.sql(f"SELECT doc_id, number, tokens, content_hash FROM ({oracle.chunks_sql(64)})").fetchall())
    assert got == want
    hot_chunks = sum(1 for r in got if r[0] == "-1")
    assert hot_chunks * 3 >= len(got) * 0.9  # the hot document holds about a third of all chunks


def test_hot_document_verification(spark):
    opts = ChunkOptions(factor=1 / 128)
    prepared = materialize(prepare(corpus_from_table(_hot_corpus(spark)), opts))
    info, chunks = document_info_table(prepared, opts, "m"), chunks_table(prepared, opts)
    res = {r.doc_id: (r.is_valid, r.reason) for r in verify_documents(info, corrupt_chunks(chunks), "strict").collect()}
    assert res["-1"][0] is False  # the hot document surely has a corrupted chunk
    clean = verify_documents(info, chunks, "strict")
    assert clean.where(~F.col("is_valid")).count() == 0
