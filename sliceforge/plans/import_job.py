"""The import job (section 3.1) as one DataFrame plan.

    corpus -> checks (decode, blank, special tokens)           narrow
           -> sentence split + pack + recount / hash            narrow
           -> per-document rows with the chunk array            (written once)
           -> chunks, document_info, processing_state,
              versions, manifest entries, processing_runs       narrow projections
           -> manifest header                                   one tiny global aggregate

There is no ``groupBy doc_id``: a document's chunks are born in one task,
so per-document totals and lists are array expressions on that row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions, model_config
from sliceforge.functions.tokens import Counter, get_counter
from sliceforge.operators.chunker import annotate_chunks, chunk_arrays, explode_chunks, sentence_pieces
from sliceforge.operators.stats import chunk_id_list, chunk_info_list, document_stats
from sliceforge.operators.validate import first_error, no_chunks_error, pre_chunk_error


def stable_id(*parts: Column | str) -> Column:
    """Deterministic replacement for ``uuid4``: MD5 of the joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def run_ts(opts: ChunkOptions) -> Column:
    """One timestamp literal per run (``now()`` would differ per query)."""
    return F.to_timestamp(F.lit(opts.run_ts))


def counter_for(opts: ChunkOptions) -> Counter:
    """The counter of a run; BPE uses the encoding of the model's registry entry
    unless ``extra`` names another."""
    if opts.counter == "bpe":
        encoding = opts.extra.get("encoding", model_config(opts.model_name)["encoding"])
        return get_counter("bpe", encoding=encoding, on_special=opts.on_special)
    return get_counter(opts.counter)


#: Session setting: partitions to spread the input over before chunking.
INPUT_PARTITIONS = "spark.sliceforge.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """The input as it is scanned, or, if the session names a number of
    partitions, dealt out over them.

    For sources of a few large row groups only (a scan cannot split a row
    group): it shuffles the texts, so it is asked for and never guessed.
    """
    asked = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(asked)) if asked else df


def prepare(
    corpus: DataFrame,
    opts: ChunkOptions,
    counter: Counter | None = None,
    strategy: str = "greedy",
) -> DataFrame:
    """One row per input document: checks, chunk array, totals, statistics.

    Columns: source_id (if the corpus has it), doc_id, filename, path, text,
    error, ok, chunk_meta, total_chunks, total_tokens, total_chars, total_lines,
    file_size, md5_hash.
    """
    counter = counter or counter_for(opts)
    pre = corpus.withColumn("error", pre_chunk_error(corpus, counter))
    pieces = sentence_pieces(F.col("text"), strategy, opts.splitter)
    # P4 from the (Catalyst) sentence array, not from the packer output.
    err = first_error(F.col("error"), no_chunks_error(F.col("_pieces"), F.col("path")))
    checked = (
        pre.withColumn("_pieces", F.when(F.col("error").isNull(), pieces))
        .withColumn("error", err)
        .withColumn("ok", F.col("error").isNull())
    )
    arrays = chunk_arrays(
        checked, opts.limit, counter, strategy, opts.splitter, opts.order, pieces_col="_pieces", engine=opts.engine
    )
    # A packer that gave up on a document fails that document (R2).
    arrays = arrays.withColumn("error", first_error(F.col("error"), F.col("pack_error")))
    arrays = arrays.withColumn("ok", F.col("error").isNull())
    ann = annotate_chunks(arrays, counter, first_number=1 if strategy == "greedy" else 0)
    return ann.select(
        *[c for c in ("source_id",) if c in corpus.columns],
        "doc_id",
        "filename",
        "path",
        "text",
        "error",
        "ok",
        "chunk_meta",
        F.when(F.col("ok"), F.col("total_chunks")).alias("total_chunks"),
        F.when(F.col("ok"), F.col("total_tokens")).alias("total_tokens"),
        *document_stats(F.col("text")),
    )


def without_texts(prepared: DataFrame) -> DataFrame:
    """Chunk texts in a column of their own (``chunk_texts``), so that a reader of
    the records' metadata does not read them."""
    texts = F.col("chunk_meta.text")
    meta = F.transform("chunk_meta", lambda c: c.dropFields("text"))
    return prepared.withColumn("chunk_texts", texts).withColumn("chunk_meta", meta)


def with_texts(stored: DataFrame) -> DataFrame:
    """Inverse of :func:`without_texts`."""
    pairs = F.arrays_zip(F.col("chunk_meta").alias("m"), F.col("chunk_texts").alias("t"))
    meta = F.transform(
        pairs,
        lambda p: F.struct(
            p["m"]["number"].alias("number"),
            p["t"].alias("text"),
            p["m"]["tokens"].alias("tokens"),
            p["m"]["content_hash"].alias("content_hash"),
            p["m"]["character_count"].alias("character_count"),
        ),
    )
    return stored.withColumn("chunk_meta", meta).drop("chunk_texts")


@dataclass
class ImportTables:
    prepared: DataFrame
    chunks: DataFrame | None
    document_info: DataFrame
    processing_state: DataFrame
    versions: DataFrame
    manifest_entries: DataFrame
    manifest: DataFrame
    processing_runs: DataFrame
    import_summary: DataFrame
    extra: dict = field(default_factory=dict)


def chunks_table(prepared: DataFrame, opts: ChunkOptions) -> DataFrame:
    """K2 content: one row per chunk with text and ``ChunkInfo`` fields.

    Failed documents carry a null chunk array and produce no rows, so no
    filter is needed (and none is pushed under the packer).
    """
    return explode_chunks(prepared).withColumn("created_at", run_ts(opts))


def document_info_table(prepared: DataFrame, opts: ChunkOptions, manifest_id: str) -> DataFrame:
    """K3 content: ``DocumentInfo`` per imported document."""
    ts = run_ts(opts)
    did = F.col("doc_id")
    return prepared.where("ok").select(
        did.alias("id"),
        "filename",
        F.concat(did, F.lit("/source/"), F.col("filename")).alias("original_path"),
        "total_chunks",
        "total_tokens",
        "total_chars",
        "total_lines",
        F.lit(opts.model_name).alias("model_name"),
        F.lit(opts.limit).alias("token_limit"),
        "md5_hash",
        "file_size",
        chunk_info_list(F.col("chunk_meta"), did, ts).alias("chunks"),
        ts.alias("processed_at"),
        stable_id(opts.run_id, did, "version").alias("version_id"),
        F.lit(manifest_id).alias("manifest_id"),
    )


def processing_state_table(prepared: DataFrame) -> DataFrame:
    """State of every document, also failed ones (R2)."""
    ok = F.col("ok")
    return prepared.select(
        "doc_id",
        F.when(ok, F.element_at("chunk_meta", -1)["number"]).otherwise(F.lit(0)).cast("int").alias("current_chunk"),
        F.when(ok, chunk_id_list(F.col("chunk_meta"), F.col("doc_id"))).otherwise(F.array().cast("array<string>")).alias("processed_chunks"),
        ok.alias("is_complete"),
        F.col("error").alias("error_message"),
    )


def versions_table(prepared: DataFrame, opts: ChunkOptions, parent_version_id: str | None = None, description: str | None = None) -> DataFrame:
    """V1: one content version per imported document."""
    return prepared.where("ok").select(
        stable_id(opts.run_id, F.col("doc_id"), "version").alias("version_id"),
        run_ts(opts).alias("created_at"),
        F.col("md5_hash").alias("content_hash"),
        F.lit(parent_version_id).cast("string").alias("parent_version_id"),
        F.lit(description).cast("string").alias("changes_description"),
        "doc_id",
    )


def manifest_entries_table(prepared: DataFrame, opts: ChunkOptions, manifest_id: str, run_seq: int = 0) -> DataFrame:
    """A4 re-aimed: the manifest's per-document lists (document_ids,
    content_hashes, version_history) as a table, one row per document.

    A single manifest row holding every id of a 100 TB corpus would pass
    the whole corpus through one task; the header keeps only scalars.
    """
    return prepared.where("ok").select(
        F.lit(manifest_id).alias("manifest_id"),
        F.lit(run_seq).cast("int").alias("run_seq"),
        "doc_id",
        F.col("md5_hash").alias("content_hash"),
        stable_id(opts.run_id, F.col("doc_id"), "version").alias("version_id"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"),
        F.col("total_tokens").cast("bigint").alias("total_tokens"),
    )


def _half(md5: str, start: int) -> Column:
    """16 hex digits of an MD5 as a signed long."""
    return F.conv(F.substring(md5, start, 16), 16, -10).cast("bigint")


def _hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def hash_xor(md5: str) -> Column:
    """Exclusive or of whole MD5s (32 hex digits): a digest of a set of rows
    that cannot overflow and adds up over partial results."""
    halves = [F.coalesce(F.bit_xor(_half(md5, start)), F.lit(0).cast("bigint")) for start in (1, 17)]
    return F.concat(*map(_hex, halves))


def manifest_header(entries: DataFrame, opts: ChunkOptions, manifest_id: str, created_at: str | None = None) -> DataFrame:
    """A3: totals over all entries (old runs included: V7 append-import).

    A global aggregate of scalars; partial sums are combined map-side, so the
    single reducer sees one row per input partition.
    """
    return entries.agg(
        F.lit(manifest_id).alias("manifest_id"),
        F.to_timestamp(F.lit(created_at or opts.run_ts)).alias("created_at"),
        run_ts(opts).alias("updated_at"),
        F.count("*").cast("bigint").alias("document_count"),
        F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("bigint").alias("total_chunks"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.lit(opts.model_name).alias("model_name"),
        F.max_by("version_id", F.struct("run_seq", "doc_id")).alias("latest_version_id"),
        hash_xor("content_hash").alias("content_hashes_xor"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def processing_runs_table(prepared: DataFrame, opts: ChunkOptions, manifest_id: str, completed_ts: str | None = None) -> DataFrame:
    """One run record per imported document, in its final state."""
    start = run_ts(opts)
    end = F.to_timestamp(F.lit(completed_ts or opts.run_ts))
    did = F.col("doc_id")
    duration = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return prepared.where("ok").select(
        stable_id(opts.run_id, did, "processing").alias("processing_id"),
        start.alias("started_at"),
        end.alias("completed_at"),
        F.lit(manifest_id).alias("manifest_id"),
        stable_id(opts.run_id, did, "version").alias("version_id"),
        F.array(did).alias("document_ids"),
        chunk_id_list(F.col("chunk_meta"), did).alias("chunk_ids"),
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.struct(
            start.alias("start_time"),
            end.alias("end_time"),
            duration.cast("double").alias("duration"),
            F.col("total_tokens").alias("total_tokens"),
            F.col("total_chunks").alias("total_chunks"),
            F.lit(opts.model_name).alias("model_name"),
            F.lit(opts.limit).alias("token_limit"),
        ).alias("processing_stats"),
    )


def import_summary(prepared: DataFrame) -> DataFrame:
    """A5: processed vs total files, failures."""
    return prepared.agg(
        F.count("*").cast("bigint").alias("total_files"),
        F.count_if(F.col("ok")).cast("bigint").alias("processed_files"),
        F.count_if(~F.col("ok")).cast("bigint").alias("failed_files"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("total_chunks"))), F.lit(0)).cast("bigint").alias("total_chunks"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("total_tokens"))), F.lit(0)).cast("bigint").alias("total_tokens"),
    )


def build_tables(
    prepared: DataFrame,
    opts: ChunkOptions,
    manifest_id: str | None = None,
    old_entries: DataFrame | None = None,
    run_seq: int = 0,
    parent_version_id: str | None = None,
    description: str | None = None,
    completed_ts: str | None = None,
    manifest_created_at: str | None = None,
    with_chunks: bool = True,
) -> ImportTables:
    manifest_id = manifest_id or default_manifest_id(opts)
    entries = manifest_entries_table(prepared, opts, manifest_id, run_seq)
    all_entries = entries if old_entries is None else old_entries.unionByName(entries)
    return ImportTables(
        prepared=prepared,
        chunks=chunks_table(prepared, opts) if with_chunks else None,
        document_info=document_info_table(prepared, opts, manifest_id),
        processing_state=processing_state_table(prepared),
        versions=versions_table(prepared, opts, parent_version_id, description),
        manifest_entries=all_entries,
        manifest=manifest_header(all_entries, opts, manifest_id, manifest_created_at),
        processing_runs=processing_runs_table(prepared, opts, manifest_id, completed_ts),
        import_summary=import_summary(prepared),
    )


def default_manifest_id(opts: ChunkOptions) -> str:
    import hashlib

    return hashlib.md5(f"manifest|{opts.run_id}".encode()).hexdigest()
