"""Running the import (and verification) as a job that writes tables.

    prepare -> write ``documents`` (source text, per-document results, chunk
               metadata, chunk texts in a column of their own)    <- lineage cut
            -> read back, explode -> ``chunks``                   narrow
            -> read back (no text) -> document_info / state / versions /
               manifest entries / runs                            (narrow)
            -> totals of this run's entries                       (tiny agg)
            -> the run's completing entry in the journal          (commit)
            -> optional verification over the stored tables       (join)

Every output is a deterministic function of the input and ``run_id``, so a
task lost mid-write is recomputed to the same rows.  Runs into one folder may go
on at the same time: the journal (``plans.journal``) numbers them, each writes
``run_seq`` partitions of its own, and readers see them when they have completed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.operators.verify import verification_summary, verify_documents
from sliceforge.plans.import_job import (
    build_tables,
    chunks_table,
    counter_for,
    default_manifest_id,
    manifest_header,
    prepare,
    spread,
    with_texts,
    without_texts,
)
from sliceforge.plans.journal import DAY, SUMS, complete_run, fail_run, run_log, start_run
from sliceforge.sinks.writers import write_chunks, write_table
from sliceforge.sources.corpus import corpus_from_table, scan_corpus
from sliceforge.sources.tables import read_chunk_texts, read_document_info, read_run, read_table


def _now() -> str:
    return dt.datetime.now().strftime("%Y-%m-%d %H:%M:%S.%f")


def run_import(
    spark: SparkSession,
    source: str | DataFrame,
    output_dir: str,
    opts: ChunkOptions | None = None,
    verify_mode: str | None = None,
    previous_version_id: str | None = None,
    changes_description: str | None = None,
    strategy: str = "greedy",
    prepared_corpus: bool = False,
    run_seq: int | None = None,
    keep_source: bool = True,
    abandon_after_s: float = DAY,
) -> dict:
    """Import a folder / file of ``.txt`` or a ``(doc_id, text)`` table.

    ``keep_source`` (default, as the reference copies each input file) stores
    the source text in ``documents``; for a corpus that already lives in a
    table, ``False`` avoids writing it a second time.

    The run is recorded as processing before it works, and as completed or failed
    (with the error, which is raised) after.  Runs that began more than
    ``abandon_after_s`` ago and never ended are recorded as failed at the start.
    """
    opts = opts or ChunkOptions()
    opts.limit  # validates model, factor and limit before any job starts (P2)
    fell_back = False
    if opts.counter == "auto":
        # BPE with the model's encoding, else the rule counter (and the
        # lossless splitter), decided once on the driver and reported.
        from sliceforge.config import model_config
        from sliceforge.functions.tokens import resolve_counter

        encoding = opts.extra.get("encoding", model_config(opts.model_name)["encoding"])
        counter, splitter, fell_back = resolve_counter("bpe", encoding=encoding)
        extra = dict(opts.extra, encoding=counter.spec.encoding) if counter.name == "bpe" else opts.extra
        opts = replace(opts, counter=counter.name, splitter=splitter, extra=extra)
    if opts.run_ts == ChunkOptions().run_ts:
        opts = replace(opts, run_ts=_now())
    log = run_log(spark, output_dir)
    started = start_run(log, opts, default_manifest_id(opts), run_seq, abandon_after_s)
    seq, attempt = started["run_seq"], started["attempt"]
    try:
        result, totals, completed_ts = _run_import(spark, source, output_dir, opts, previous_version_id, changes_description,
                                                   strategy, prepared_corpus, seq, started["header"]["manifest_id"], keep_source)
    except Exception as exc:
        fail_run(log, seq, attempt, f"{type(exc).__name__}: {exc}"[:2000])
        raise
    entry = complete_run(log, seq, attempt, totals, completed_ts)
    result["elapsed_s"] = round(entry["duration"], 3)
    if verify_mode:
        result["verification"] = run_verification(spark, output_dir, verify_mode, opts)
    encoding = counter_for(opts).spec.encoding if opts.counter == "bpe" else None
    result.update(counter=opts.counter, encoding=encoding, splitter=opts.splitter, counter_fallback=fell_back)
    return result


def _run_import(spark, source, output_dir, opts, previous_version_id, changes_description, strategy, prepared_corpus, run_seq,
                manifest_id, keep_source=True) -> tuple[dict, dict, str]:
    """Writes the partitions of a run; returns its figures, the totals that it adds
    to the manifest, and when it was done."""
    # Every run makes documents of its own, from files and tables alike.
    run = f"{opts.run_id}#{run_seq}"
    if isinstance(source, str):
        corpus = scan_corpus(spark, source, run)
    else:
        corpus = source if prepared_corpus else corpus_from_table(source, run=run)
        if corpus.isEmpty():  # S3 for tables (the file scan checks its own listing)
            raise ValueError("No documents to import")

    # Progress metrics collected while the first table is written.
    obs = Observation("import_progress")
    prepared = prepare(spread(corpus), opts, counter_for(opts), strategy).withColumn("run_seq", F.lit(run_seq))
    observed = prepared.observe(
        obs,
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("ok")).alias("processed_files"),
        F.sum(F.when(F.col("ok"), F.col("total_chunks"))).alias("chunks"),
        F.sum(F.when(F.col("ok"), F.col("total_tokens"))).alias("tokens"),
    )
    # K1 + lineage cut: the packer runs once, in the job that writes source text,
    # results and chunk texts; everything else is read from that table.
    documents = without_texts(observed)
    if not keep_source:
        documents = documents.drop("text")
    write_table(documents, output_dir, "documents", run_seq=run_seq)
    docs = read_run(spark, output_dir, "documents", run_seq)
    # K2: one row per chunk.
    write_chunks(chunks_table(with_texts(docs), opts), output_dir, "overwrite", run_seq)
    docs = docs.drop("chunk_texts")
    docs = docs.drop("text") if "text" in docs.columns else docs
    completed = _now()

    tables = build_tables(
        docs,
        opts,
        manifest_id=manifest_id,
        run_seq=run_seq,
        parent_version_id=previous_version_id,
        description=changes_description,
        completed_ts=completed,
        with_chunks=False,
    )
    for name, df in (
        ("document_info", tables.document_info),
        ("processing_state", tables.processing_state),
        ("versions", tables.versions),
        ("processing_runs", tables.processing_runs),
    ):
        write_table(df, output_dir, name, run_seq=run_seq)
    write_table(tables.manifest_entries, output_dir, "manifest_entries", run_seq=run_seq)
    # A3: this run's totals, one row; the commit adds them to the manifest's.
    sums = manifest_header(read_run(spark, output_dir, "manifest_entries", run_seq), opts, manifest_id).first()
    totals = {c: sums[c] for c in (*SUMS, "latest_version_id", "content_hashes_xor")}

    metrics = dict(obs.get)
    result = {
        "run_id": opts.run_id,
        "run_seq": run_seq,
        "manifest_id": manifest_id,
        "files": int(metrics.get("files") or 0),
        "processed_files": int(metrics.get("processed_files") or 0),
        "failed_files": int((metrics.get("files") or 0) - (metrics.get("processed_files") or 0)),
        "chunks": int(metrics.get("chunks") or 0),
        "tokens": int(metrics.get("tokens") or 0),
    }
    return result, totals, completed


def run_verification(
    spark: SparkSession, output_dir: str, mode: str = "strict", opts: ChunkOptions | None = None, run_seqs: list | None = None
) -> dict:
    """Verify every stored document (all runs, as the reference does) and write
    the per-document result.  ``run_seqs`` restricts it to some runs; the
    ``run_seq`` partitions of both tables are then pruned at the scan."""
    opts = opts or ChunkOptions()
    info, chunks = read_document_info(spark, output_dir), read_chunk_texts(spark, output_dir)
    if run_seqs is not None:
        info = info.where(F.col("run_seq").isin(list(run_seqs)))
        chunks = chunks.where(F.col("run_seq").isin(list(run_seqs)))
    res = verify_documents(info, chunks, mode, counter_for(opts))
    write_table(res, output_dir, f"verification_{mode}", "overwrite")
    s = verification_summary(read_table(spark, output_dir, f"verification_{mode}")).first()
    return {"mode": mode, "valid": int(s.valid), "invalid": int(s.invalid)}
