"""The import job over files and tables, append-import, lookups, streaming."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.plans.run import run_import
from sliceforge.sources.corpus import scan_corpus
from sliceforge.sources.tables import read_chunk, read_document, read_manifest

from .conftest import SF_SMALL


def _tree():
    src = tempfile.mkdtemp(prefix="sliceforge-src-")
    os.makedirs(f"{src}/sub")
    with open(f"{src}/a.txt", "w") as f:
        f.write("Hello there. General Kenobi.")
    with open(f"{src}/sub/n.txt", "w") as f:
        f.write("Nested file. Two sentences.")
    with open(f"{src}/blank.txt", "w") as f:
        f.write("  \n ")
    for name, body in (("note.md", "not me."), ("UP.TXT", "not me either.")):
        with open(f"{src}/{name}", "w") as f:
            f.write(body)
    with open(f"{src}/bad.txt", "wb") as f:
        f.write(b"ok \xff\xfe .")
    return src


def _empty_dir():
    d = tempfile.mkdtemp(prefix="sliceforge-empty-")
    with open(f"{d}/readme.md", "w") as f:
        f.write("no text files here.")
    return d


def test_scan_rules(spark):
    src = _tree()
    names = sorted(r.filename for r in scan_corpus(spark, src).collect())
    assert names == ["a.txt", "bad.txt", "blank.txt", "n.txt"]
    with pytest.raises(ValueError, match="expected a folder or a file"):
        scan_corpus(spark, f"{src}/note.md")
    assert scan_corpus(spark, f"{src}/a.txt").count() == 1
    with pytest.raises(ValueError, match="expected a folder or a file"):
        scan_corpus(spark, f"{src}/missing.txt")
    with pytest.raises(ValueError, match="holds no .txt file"):
        scan_corpus(spark, _empty_dir())


def test_empty_files_fail_as_empty(spark, tmp_out):
    src = _tree()
    os.makedirs(f"{src}/with space é")
    open(f"{src}/with space é/empty file.txt", "w").close()
    rows = {r.filename: r for r in scan_corpus(spark, src).collect()}
    assert rows["empty file.txt"].text == "" and len(rows) == 5
    r = run_import(spark, src, tmp_out, ChunkOptions(factor=1 / 32, run_id="e"))
    assert (r["files"], r["processed_files"], r["failed_files"]) == (5, 2, 3)
    only = tempfile.mkdtemp(prefix="sliceforge-src-")
    open(f"{only}/empty.txt", "w").close()
    assert [(x.filename, x.text) for x in scan_corpus(spark, only).collect()] == [("empty.txt", "")]
    assert scan_corpus(spark, f"{only}/empty.txt").count() == 1


def test_import_append_and_verify(spark, tmp_out):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    r1 = run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 32, run_id="one"), verify_mode="strict")
    assert r1["files"] == r1["processed_files"] == docs.count()
    assert r1["verification"]["invalid"] == 0
    r2 = run_import(spark, _tree(), tmp_out, ChunkOptions(factor=1 / 32, run_id="two"), verify_mode="lenient")
    assert (r2["files"], r2["processed_files"], r2["failed_files"]) == (4, 2, 2)
    header, entries = read_manifest(spark, tmp_out)
    h = header.first()
    assert h.manifest_id == r1["manifest_id"] == r2["manifest_id"]
    assert h.document_count == r1["processed_files"] + 2 == entries.count()
    assert h.total_chunks == r1["chunks"] + r2["chunks"]
    state = spark.read.parquet(f"{tmp_out}/processing_state").where("run_seq = 1")
    errors = sorted(r.error_message[:12] for r in state.where("not is_complete").collect())
    assert errors[0].startswith("'utf-8'") and errors[1].startswith("File ")
    from sliceforge.plans.run import run_verification

    only_second = run_verification(spark, tmp_out, "strict", run_seqs=[1])
    assert (only_second["valid"], only_second["invalid"]) == (2, 0)
    first = spark.read.parquet(f"{tmp_out}/chunks").where("run_seq = 0").orderBy("doc_id", "number").first()
    assert read_chunk(spark, tmp_out, first.id).first().text == first.text
    assert read_document(spark, tmp_out, first.doc_id).count() == 1


def test_import_of_the_same_table_twice(spark, tmp_out):
    """Two runs make two sets of documents, also under one run id; both verify."""
    from sliceforge.plans.run import run_verification

    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    opts = ChunkOptions(factor=1 / 128, run_id="same")
    first = run_import(spark, docs, tmp_out, opts)
    chunks = spark.read.parquet(f"{tmp_out}/chunks")
    before = sorted(map(tuple, chunks.select("id", "content_hash").collect()))
    second = run_import(spark, docs, tmp_out, opts, verify_mode="strict")
    n = docs.count()
    assert second["verification"] == {"mode": "strict", "valid": 2 * n, "invalid": 0}
    for mode in ("token", "lenient"):
        assert run_verification(spark, tmp_out, mode)["invalid"] == 0
    chunks = spark.read.parquet(f"{tmp_out}/chunks")
    assert sorted(map(tuple, chunks.where("run_seq = 0").select("id", "content_hash").collect())) == before
    assert chunks.count() == 2 * len(before) == chunks.select("id").distinct().count()
    info = spark.read.parquet(f"{tmp_out}/document_info")
    assert info.select("id").distinct().count() == 2 * n
    row = chunks.first()
    assert read_chunk(spark, tmp_out, row.id).count() == 1 and read_document(spark, tmp_out, row.doc_id).count() == 1
    sources = spark.read.parquet(f"{tmp_out}/documents").groupBy("source_id").count()
    assert {r["count"] for r in sources.collect()} == {2}
    assert first["processed_files"] == second["processed_files"] == n


def test_damage_is_found_in_its_run_only(spark, tmp_out):
    from sliceforge.operators.verify import verify_documents
    from sliceforge.sources.tables import read_chunk_texts, read_document_info

    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    for run_id in ("one", "two"):
        run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 128, run_id=run_id))
    stored = read_chunk_texts(spark, tmp_out)
    damaged = stored.withColumn("text", F.when((F.col("run_seq") == 1) & F.col("id").endswith("-chunk-1"), "x").otherwise(F.col("text")))
    got = verify_documents(read_document_info(spark, tmp_out), damaged, "strict").collect()
    assert {(r.run_seq, r.is_valid) for r in got} == {(0, True), (1, False)}


def test_continuous_import(spark, tmp_out):
    from sliceforge.streaming.continuous import start_continuous_import

    src = _tree()
    ckpt = tempfile.mkdtemp(prefix="sliceforge-stream-")
    q = start_continuous_import(spark, src, tmp_out, ckpt, ChunkOptions(factor=1 / 128, run_id="s"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    st = spark.read.parquet(f"{tmp_out}/processing_state")
    assert st.count() == 4 and st.where("is_complete").count() == 2
    assert spark.read.parquet(f"{tmp_out}/chunks").agg(F.count("*")).first()[0] >= 2


def test_replayed_epoch_is_idempotent(spark, tmp_out):
    from sliceforge.streaming.continuous import _batch_runner

    src = _tree()
    batch = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(src)
    run = _batch_runner(tmp_out, ChunkOptions(factor=1 / 128, run_id="s"))
    run(batch, 0)
    first = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_out}/chunks").select("id", "content_hash").collect())
    run(batch, 0)  # the same epoch again, as after a failure before the checkpoint commit
    again = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_out}/chunks").select("id", "content_hash").collect())
    assert first == again
    header, entries = read_manifest(spark, tmp_out)
    assert header.first().document_count == entries.count() == 2


def test_auto_counter_falls_back_and_reports(spark, tmp_out):
    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    # cl100k_base (the registry's encoding) is not available offline: fallback, reported.
    r = run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 128, run_id="auto", counter="auto"))
    assert (r["counter"], r["splitter"], r["counter_fallback"]) == ("regex", "lossless", True)
    r2 = run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 128, run_id="auto2", counter="auto", extra={"encoding": "byte_bpe_50k"}))
    assert (r2["counter"], r2["counter_fallback"]) == ("bpe", False) and r2["tokens"] > 0


def test_stream_after_batch_runs_does_not_overwrite(spark, tmp_out):
    from sliceforge.streaming.continuous import start_continuous_import

    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    first = run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 128, run_id="batch"))
    ckpt = tempfile.mkdtemp(prefix="sliceforge-stream-")
    q = start_continuous_import(spark, _tree(), tmp_out, ckpt, ChunkOptions(factor=1 / 128, run_id="s"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    state = spark.read.parquet(f"{tmp_out}/processing_state")
    assert state.where("run_seq = 0").count() == first["files"]  # the batch run is intact
    assert state.where("run_seq = 1").count() == 4
    header, entries = read_manifest(spark, tmp_out)
    assert header.first().document_count == entries.count() == first["processed_files"] + 2


def test_empty_table_is_refused(spark, tmp_out):
    empty = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError, match="No documents"):
        run_import(spark, empty, tmp_out, ChunkOptions(factor=1 / 128))


def test_version_parent_and_description(spark, tmp_out):
    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 128, run_id="v"), previous_version_id="v-prev", changes_description="edited")
    versions = spark.read.parquet(f"{tmp_out}/versions")
    assert {(r.parent_version_id, r.changes_description) for r in versions.collect()} == {("v-prev", "edited")}
    info = spark.read.parquet(f"{tmp_out}/document_info")
    joined = info.join(versions.select(F.col("version_id"), F.col("doc_id").alias("id")), ["id", "version_id"])
    assert joined.count() == info.count()  # each record points at its own version


def test_continuous_import_picks_up_new_files(spark, tmp_out):
    from sliceforge.streaming.continuous import start_continuous_import

    src = tempfile.mkdtemp(prefix="sliceforge-live-")
    with open(f"{src}/one.txt", "w") as f:
        f.write("First file. It has two sentences.")
    ckpt = tempfile.mkdtemp(prefix="sliceforge-stream-")
    q = start_continuous_import(spark, src, tmp_out, ckpt, ChunkOptions(factor=1 / 128, run_id="live"), trigger_seconds=1)
    try:
        q.processAllAvailable()
        with open(f"{src}/two.txt", "w") as f:
            f.write("Second file arrives later.")
        q.processAllAvailable()
    finally:
        q.stop()
    state = spark.read.parquet(f"{tmp_out}/processing_state")
    assert state.count() == 2 and state.select("run_seq").distinct().count() == 2
    header, _ = read_manifest(spark, tmp_out)
    assert header.first().document_count == 2


def test_manifest_keeps_its_model(spark, tmp_out):
    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    run_import(spark, docs, tmp_out, ChunkOptions(model_name="gpt-4", factor=1 / 128, run_id="m1"))
    run_import(spark, docs, tmp_out, ChunkOptions(model_name="claude", factor=1 / 128, run_id="m2"))
    header, _ = read_manifest(spark, tmp_out)
    assert header.first().model_name == "gpt-4"
    models = {r.model_name for r in spark.read.parquet(f"{tmp_out}/document_info").select("model_name").collect()}
    assert models == {"gpt-4", "claude"}  # each document records the model it was chunked for


def test_without_source_copy(spark, tmp_out):
    docs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")
    r = run_import(spark, docs, tmp_out, ChunkOptions(factor=1 / 128, run_id="nosrc"), keep_source=False, verify_mode="strict")
    assert "text" not in spark.read.parquet(f"{tmp_out}/documents").columns
    assert r["verification"]["invalid"] == 0 and r["chunks"] > 0
