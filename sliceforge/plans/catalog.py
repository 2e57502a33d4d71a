"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their
DuckDB SQL (see ``oracle``).  Every query reads the whole driver tables.

Outputs are flat (no arrays / maps / timestamps): lists are compared through
an MD5 of their ordered, joined elements, integers are BIGINT on both sides.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceforge.config import MODEL_CONFIGS, ChunkOptions
from sliceforge.functions.sentences import get_splitter
from sliceforge.functions.text import is_blank
from sliceforge.functions.tokens import decode_with_vocabulary, get_counter, regex_count, vocabulary
from sliceforge.operators.records import (
    create_chunk_records,
    created_history,
    delete_records,
    document_chunk_entries,
    get_records,
    update_records,
    upsert_document_chunks,
)
from sliceforge.operators.stats import model_limits, with_model_limit
from sliceforge.operators.verify import corrupt_chunks, verification_summary_all, verify_all_modes, verify_documents
from sliceforge.operators.vocabulary import decode_texts, encode_texts, extend_vocabulary, read_vocabulary
from sliceforge.plans import oracle
from sliceforge.plans.changes import apply_changes, apply_upserts, create_chunk_store, create_document_store
from sliceforge.plans.import_job import (
    default_manifest_id,
    chunks_table,
    document_info_table,
    hash_xor,
    import_summary,
    manifest_entries_table,
    manifest_header,
    prepare,
    processing_runs_table,
    processing_state_table,
    spread,
    versions_table,
    with_texts,
    without_texts,
)
from sliceforge.plans.journal import read_runs
from sliceforge.plans.run import run_import
from sliceforge.session import materialize, scratch_path
from sliceforge.sinks.record_store import lookup_store, read_history, read_store
from sliceforge.sources.corpus import corpus_from_table
from sliceforge.sources.tables import read_manifest, read_table

log = logging.getLogger(__name__)

QueryFn = Callable[[SparkSession, str], DataFrame]

# gpt-4 (8,192 tokens) with reduction factors 1/128, 1/32 and 1/1024: limits 64, 256 and 8.
F64 = 1 / 128
F256 = 1 / 32
F8 = 1 / 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def options(factor: float = F64, **kw) -> ChunkOptions:
    return ChunkOptions(model_name="gpt-4", factor=factor, run_id="r1", run_ts="2024-01-01 00:00:00", **kw)


def corpus(spark, sf_dir, name="documents", id_col="doc_id", text_col="text"):
    """Scan only the id and text columns; spread before any per-row work."""
    raw = table(spark, sf_dir, name).select(id_col, text_col)
    return corpus_from_table(spread(raw), id_col, text_col, prefix=name)


def _bigint(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def flat_chunks(ch: DataFrame) -> DataFrame:
    return ch.select("id", "doc_id", *_bigint("number", "tokens"), "content_hash", *_bigint("character_count"))


def list_md5(arr, fn) -> F.Column:
    return F.md5(F.array_join(F.transform(arr, fn), ","))


# --------------------------------------------------------------------------
# chunking (T1-T6, C2, P6) over several corpora
# --------------------------------------------------------------------------


def q_chunks(factor=F64, order="reference", splitter="dot", name="documents", id_col="doc_id", text_col="text", engine="arrow") -> QueryFn:
    def run(spark, sf_dir):
        opts = options(factor, order=order, splitter=splitter, engine=engine)
        prepared = prepare(corpus(spark, sf_dir, name, id_col, text_col), opts)
        return flat_chunks(chunks_table(prepared, opts))

    return run


def q_conversation_chunks(spark, sf_dir):
    """T6 over conversation turns: each turn is a document ``<conv_id>-<turn>``.

    Turns are chunked where they are; a whole conversation is never gathered
    into one row (a hot conversation would otherwise be one task).
    """
    opts = options(F64)
    conv = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text"
    )
    prepared = prepare(corpus_from_table(spread(conv), prefix="conversations"), opts)
    return flat_chunks(chunks_table(prepared, opts))


def q_sentence_chunks(factor: float, engine: str = "arrow") -> QueryFn:
    """Strategy B (punctuation sentences, word / character split, ' ' join)."""

    def run(spark, sf_dir):
        opts = options(factor, engine=engine)
        prepared = prepare(corpus(spark, sf_dir), opts, strategy="sentence")
        return flat_chunks(chunks_table(prepared, opts))

    return run


def q_sentences(splitter: str) -> QueryFn:
    """One row per sentence of every non-blank document."""

    def run(spark, sf_dir):
        c = corpus(spark, sf_dir).where(~is_blank(F.col("text")))
        rows = c.select("doc_id", F.posexplode_outer(get_splitter(splitter)(F.col("text"))).alias("pos", "s")).where(
            F.col("s").isNotNull()
        )
        return rows.select(
            "doc_id",
            (F.col("pos") + 1).cast("bigint").alias("i"),
            F.md5("s").alias("sentence_md5"),
            F.char_length("s").cast("bigint").alias("chars"),
            regex_count(F.col("s")).cast("bigint").alias("tokens"),
        )

    return run


def q_token_counts(spark, sf_dir):
    """C2 over whole documents."""
    c = corpus(spark, sf_dir)
    return c.select("doc_id", regex_count(F.col("text")).cast("bigint").alias("tokens"), F.char_length("text").cast("bigint").alias("total_chars"))


def q_document_info(spark, sf_dir):
    """Document records, chunk list as checksum."""
    opts = options()
    di = document_info_table(prepare(corpus(spark, sf_dir), opts), opts, "m")
    chunk_list = list_md5(
        F.col("chunks"),
        lambda c: F.concat_ws(":", c["id"], c["tokens"].cast("string"), c["content_hash"], c["character_count"].cast("string")),
    )
    return di.select(
        "id",
        "filename",
        "original_path",
        *_bigint("total_chunks", "total_tokens", "total_chars", "total_lines"),
        "model_name",
        *_bigint("token_limit"),
        "md5_hash",
        *_bigint("file_size"),
        chunk_list.alias("chunk_list_md5"),
    )


def q_processing_state(spark, sf_dir):
    """State of every document, failed ones included."""
    return _state_rows(processing_state_table(prepare(corpus(spark, sf_dir), options())))


def _state_rows(st):
    return st.select(
        "doc_id",
        *_bigint("current_chunk"),
        F.size("processed_chunks").cast("bigint").alias("processed_count"),
        F.md5(F.array_join("processed_chunks", ",")).alias("processed_chunks_md5"),
        "is_complete",
        "error_message",
    )


def q_import_summary(spark, sf_dir):
    """A5."""
    opts = options()
    return import_summary(prepare(corpus(spark, sf_dir), opts))


def _stored_import(spark, prepared, opts, name="prepared"):
    """An import's records and chunk store, written once.  The source text is not
    needed any more, and chunk texts have a column of their own, so the records'
    side does not read them."""
    stored = materialize(without_texts(prepared.drop("text")), name)
    return document_info_table(stored.drop("chunk_texts"), opts, "m"), chunks_table(with_texts(stored), opts)


def _verify_inputs(spark, sf_dir):
    """Import once, then corrupt a deterministic subset of the stored chunks."""
    opts = options()
    info, chunks = _stored_import(spark, prepare(corpus(spark, sf_dir), opts), opts)
    return info, corrupt_chunks(chunks)


def q_reimport_verify(spark, sf_dir):
    """The same documents imported in two runs, the chunk store of
    the first run damaged; every record of both runs is verified."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    infos, stores = [], []
    for seq, run_id in enumerate(("r1", "r2")):
        opts = replace(options(), run_id=run_id)
        prepared = prepare(corpus_from_table(spread(raw), run=f"{run_id}#{seq}"), opts)
        info, chunks = _stored_import(spark, prepared, opts, f"run-{seq}")
        infos.append(info.withColumn("run_seq", F.lit(seq)))
        stores.append((corrupt_chunks(chunks) if seq == 0 else chunks).withColumn("run_seq", F.lit(seq)))
    info, store = infos[0].unionByName(infos[1]), stores[0].unionByName(stores[1])
    return verify_documents(info, store, "strict").withColumn("run_seq", F.col("run_seq").cast("bigint"))


def q_lookup_chunk(spark, sf_dir):
    """The first chunk of every labelled document, by chunk id.  A chunk's
    document is part of its id: the others are not chunked."""
    opts = options()
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    asked_docs = corpus(spark, sf_dir).join(asked.distinct(), "doc_id", "left_semi")
    chunks = chunks_table(prepare(asked_docs, opts), opts)
    return flat_chunks(get_records(chunks, asked.select(F.concat("doc_id", F.lit("-chunk-1")).alias("id"))))


def q_lookup_document(spark, sf_dir):
    """The records of all labelled documents, by document id."""
    opts = options()
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    asked = corpus(spark, sf_dir).join(ids.distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    info = document_info_table(prepare(asked, opts), opts, "m")
    return get_records(info, ids).select("id", "filename", *_bigint("total_chunks", "total_tokens"), "md5_hash")


def q_manifest_entries(spark, sf_dir):
    """A4: the manifest's lists, one row per document and run."""
    entries = _two_runs(spark, sf_dir)[0]
    return entries.select(
        "manifest_id", *_bigint("run_seq"), "doc_id", "content_hash", "version_id", *_bigint("total_chunks", "total_tokens")
    )


def mixed_documents(spark, sf_dir):
    """All documents, by a key of their id some made blank, some dots only, some
    null, some with other line ends: the inputs of the failure paths."""
    key = _key(F.col("doc_id").cast("string"), 11)
    text = (
        F.when(key == 0, F.lit(" \t\r\n "))
        .when(key == 1, F.lit("..."))
        .when(key == 2, F.lit(None).cast("string"))
        .when(key == 3, F.replace(F.col("text"), F.lit(" "), F.lit("\r\n")))
        .when(key == 4, F.replace(F.col("text"), F.lit(" "), F.lit("\r")))
        .otherwise(F.col("text"))
    )
    return corpus_from_table(spread(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))))


def q_processing_state_mixed(spark, sf_dir):
    """States of good and failed documents."""
    return _state_rows(processing_state_table(prepare(mixed_documents(spark, sf_dir), options())))


def q_import_summary_mixed(spark, sf_dir):
    """A5 with failed files."""
    return import_summary(prepare(mixed_documents(spark, sf_dir), options()))


def q_document_models(spark, sf_dir):
    """Each document's model (by a key of its id) and that model's
    token limit from the registry, against the document's tokens."""
    names = sorted(MODEL_CONFIGS)
    c = corpus(spark, sf_dir)
    docs = c.select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, names)), (_key(F.col("doc_id"), len(names)) + 1).cast("int")).alias("model_name"),
        regex_count(F.col("text")).cast("bigint").alias("tokens"),
    )
    joined = with_model_limit(docs, model_limits(spark, "gpt-4", F64))
    return joined.select("doc_id", "model_name", *_bigint("token_limit"), "tokens", (F.col("tokens") <= F.col("token_limit")).alias("fits"))


def q_verify(mode: str) -> QueryFn:
    """J1-J5 on a corrupted store."""

    def run(spark, sf_dir):
        info, stored = _verify_inputs(spark, sf_dir)
        return verify_documents(info, stored, mode)

    return run


def q_verification_summary(spark, sf_dir):
    """A6 per mode."""
    info, stored = _verify_inputs(spark, sf_dir)
    return verification_summary_all(verify_all_modes(info, stored))


def q_versions(spark, sf_dir):
    """V1."""
    opts = options()
    return versions_table(prepare(corpus(spark, sf_dir), opts), opts).drop("created_at")


def q_processing_runs(spark, sf_dir):
    """R3 / R4 / A9."""
    opts = options()
    runs = processing_runs_table(prepare(corpus(spark, sf_dir), opts), opts, "m")
    return runs.select(
        "processing_id",
        "manifest_id",
        "version_id",
        F.element_at("document_ids", 1).alias("doc_id"),
        F.size("chunk_ids").cast("bigint").alias("chunk_id_count"),
        F.md5(F.array_join("chunk_ids", ",")).alias("chunk_ids_md5"),
        "status",
        F.col("processing_stats.total_tokens").cast("bigint").alias("total_tokens"),
        F.col("processing_stats.total_chunks").cast("bigint").alias("total_chunks"),
        F.col("processing_stats.model_name").alias("model_name"),
        F.col("processing_stats.token_limit").cast("bigint").alias("token_limit"),
        F.col("processing_stats.duration").alias("duration"),
    )


def q_manifest_append(spark, sf_dir):
    """A3 / A4 / V6 / V7: import documents (run 1), then benchmark items
    (run 2) into the same manifest; header over both."""
    entries, o1, o2, mid = _two_runs(spark, sf_dir)
    header = manifest_header(entries, o2, mid, created_at=o1.run_ts)
    return header.select(
        "manifest_id", "document_count", "total_chunks", "total_tokens", "model_name", "latest_version_id", "content_hashes_xor"
    )


def _two_runs(spark, sf_dir):
    """Manifest entries of documents (run 0) and benchmark items (run 1)."""
    o1 = options()
    o2 = ChunkOptions(model_name="gpt-4", factor=F64, run_id="r2", run_ts="2024-01-02 00:00:00")
    mid = default_manifest_id(o1)
    e1 = manifest_entries_table(prepare(corpus(spark, sf_dir), o1), o1, mid, run_seq=0)
    e2 = manifest_entries_table(prepare(corpus(spark, sf_dir, "benchmark", "item_id"), o2), o2, mid, run_seq=1)
    return e1.unionByName(e2), o1, o2, mid


def _key(col, mod):
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint"), F.lit(mod))


def _records(spark, sf_dir):
    opts = options(F256)
    chunks = chunks_table(prepare(corpus(spark, sf_dir), opts), opts)
    # The record table is read by several branches and checks: materialise it
    # once (a table in spark.checkpoint.dir), as a stored table would be.
    records = materialize(create_chunk_records(chunks, opts.run_ts), "chunk_records")
    return records, created_history(records, opts.run_ts)


def q_records_update(spark, sf_dir):
    """V2 + V3 + V6: create chunk records, apply 0-2 changes each."""
    records, created = _records(spark, sf_dir)
    n = _key(F.col("id"), 3)
    changes = records.select("id", "tokens", "content_hash", n.alias("n")).select(
        "*", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))).alias("seq")
    ).where(F.col("seq") <= F.col("n"))
    changes = changes.select(
        F.col("id").alias("chunk_id"),
        F.col("seq").cast("int").alias("seq"),
        F.md5(F.concat(F.col("id"), F.lit("|v"), F.col("seq").cast("string"))).alias("version_id"),
        F.when(
            F.col("seq") == 1,
            F.create_map(
                F.lit("llm_analysis.topic"), F.substring("content_hash", 1, 6), F.lit("status"), F.lit("reviewed"),
                F.lit("llm_entity_extraction"), F.concat(F.lit('{"kind":"'), F.substring("content_hash", 13, 4), F.lit('"}')),
            ),
        )
        .otherwise(
            F.create_map(
                F.lit("llm_analysis.topic"), F.substring("content_hash", 7, 6), F.lit("tokens"), (F.col("tokens") + 1).cast("string"),
                F.lit("character_count"), F.lit(None).cast("string"),
            )
        )
        .alias("fields"),
    )
    updated, history, _ = update_records(records, changes, "2024-01-03 00:00:00")
    hist = created.unionByName(history)
    hist = hist.withColumn("link", F.md5(F.concat_ws("|", "version_id", F.coalesce("parent_version_id", F.lit("")))))
    hagg = hist.groupBy(F.col("record_id").alias("id")).agg(
        F.count("*").cast("bigint").alias("history_count"), hash_xor("link").alias("history_xor")
    )
    return updated.join(hagg, "id").select(
        "id",
        "version_id",
        F.col("tokens").cast("bigint").alias("tokens"),
        F.col("llm_analysis")["topic"].alias("topic"),
        F.col("attributes")["status"].alias("status"),
        F.col("llm_entity_extraction")["kind"].alias("entity_kind"),
        F.coalesce(F.col("character_count").cast("bigint"), F.lit(-1)).alias("character_count"),  # -1: set to null
        "history_count",
        "history_xor",
    )


def q_records_delete(spark, sf_dir):
    """V4: delete a deterministic set of ids, some of which do not exist."""
    records, _ = _records(spark, sf_dir)
    ids = records.where(_key(F.col("id"), 5) == 0).select("id").unionByName(
        records.where(_key(F.col("id"), 7) == 0).select(F.concat("id", F.lit("-gone")).alias("id"))
    )
    kept, _missing = delete_records(records, ids)
    return kept.select("id", "doc_id", F.col("number").cast("bigint").alias("number"), "version_id")


def q_document_upsert(spark, sf_dir):
    """V5: upsert chunk entries of document records (merge or append)."""
    opts = options(F256)
    # Read by two branches (entries and versions): materialise once, as the stored table.
    info = materialize(document_info_table(prepare(corpus(spark, sf_dir), opts), opts, "m"), "document_info")
    entries = document_chunk_entries(info)
    docs = info.select("id", "version_id")
    n = _key(F.col("id"), 3)
    updates = docs.select("id", n.alias("n")).select(
        "*", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))).alias("seq")
    ).where(F.col("seq") <= F.col("n"))
    updates = updates.select(
        F.col("id").alias("doc_id"),
        F.col("seq").cast("int").alias("seq"),
        F.md5(F.concat(F.col("id"), F.lit("|dv"), F.col("seq").cast("string"))).alias("version_id"),
        F.concat(F.col("id"), F.lit("-chunk-"), (F.col("seq") * 2).cast("string")).alias("chunk_id"),
        F.create_map(F.lit("reviewed"), F.col("seq").cast("string"), F.lit("tokens"), F.lit("0")).alias("fields"),
    )
    merged, _hist, _versions = upsert_document_chunks(docs, entries, updates, "2024-01-03 00:00:00")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return merged.select("doc_id", "chunk_id", text.alias("fields_text"))


def _chunk_store(spark, sf_dir):
    """A record store of all documents' chunk records."""
    opts = options(F256)
    chunks = materialize(chunks_table(prepare(corpus(spark, sf_dir), opts), opts).drop("text"), "chunks")
    root = scratch_path(spark, "chunk-store")
    create_chunk_store(chunks, root, opts.run_ts)
    return root


def q_records_apply(spark, sf_dir):
    """V2 + V3 + V4 on a stored table: two batches in turn (creates, updates and
    deletes), then the stored records with their history."""
    root = _chunk_store(spark, sf_dir)
    records = read_store(spark, root)
    n = _key(F.col("id"), 3)
    version = lambda mark, seq: F.md5(F.concat(F.col("id"), F.lit(f"|{mark}"), F.col(seq).cast("string")))
    none = F.lit(None)
    updates = records.select("id", "tokens", "content_hash", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq")).where(F.col("seq") <= n)
    updates = updates.select(
        F.lit("update").alias("action"), "id", "seq", version("v", "seq").alias("version_id"),
        F.when(F.col("seq") == 1, F.create_map(F.lit("llm_analysis.topic"), F.substring("content_hash", 1, 6), F.lit("status"), F.lit("reviewed")))
        .otherwise(F.create_map(F.lit("llm_analysis.topic"), F.substring("content_hash", 7, 6), F.lit("tokens"), (F.col("tokens") + 1).cast("string")))
        .alias("fields"),
    )
    ids = records.where(_key(F.col("id"), 5) == 0).select("id")
    ids = ids.unionByName(records.where(_key(F.col("id"), 7) == 0).select(F.concat("id", F.lit("-gone")).alias("id")))
    deletes = ids.select(F.lit("delete").alias("action"), "id", none.cast("int").alias("seq"), none.cast("string").alias("version_id"),
                         none.cast("map<string,string>").alias("fields"))
    docs = records.where("number = 1").select("doc_id").where(_key(F.col("doc_id"), 7) == 1)
    creates = docs.select(
        F.lit("create").alias("action"), F.concat("doc_id", F.lit("-summary")).alias("id"), none.cast("int").alias("seq"),
        F.md5(F.concat(F.lit("summary|"), F.col("doc_id"))).alias("version_id"),
        F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("number"), F.lit("0"), F.lit("tokens"), F.lit("0"), F.lit("kind"), F.lit("summary")).alias("fields"),
    )
    apply_changes(spark, root, updates.unionByName(deletes).unionByName(creates), "2024-01-03 00:00:00")

    records = read_store(spark, root)
    second = records.where(_key(F.col("id"), 4) == 1).select(
        F.lit("update").alias("action"), "id", F.lit(1).alias("seq"), F.md5(F.concat("id", F.lit("|w1"))).alias("version_id"),
        F.create_map(F.lit("tokens"), F.lit("1"), F.lit("note"), F.lit("second")).alias("fields"),
    )
    gone = records.where(_key(F.col("id"), 9) == 0).select(
        F.lit("delete").alias("action"), "id", none.cast("int").alias("seq"), none.cast("string").alias("version_id"),
        none.cast("map<string,string>").alias("fields"),
    )
    apply_changes(spark, root, second.unionByName(gone), "2024-01-04 00:00:00")

    history = read_history(spark, root)
    history = history.withColumn("link", F.md5(F.concat_ws("|", "version_id", F.coalesce("parent_version_id", F.lit("")))))
    links = history.groupBy(F.col("record_id").alias("id")).agg(F.count("*").cast("bigint").alias("history_count"), hash_xor("link").alias("history_xor"))
    return read_store(spark, root).join(links, "id").select(
        "id", "doc_id", "version_id", *_bigint("number", "tokens"),
        F.col("llm_analysis")["topic"].alias("topic"),
        F.col("attributes")["status"].alias("status"),
        F.col("attributes")["note"].alias("note"),
        F.col("attributes")["kind"].alias("kind"),
        "history_count", "history_xor",
    )


def q_documents_apply(spark, sf_dir):
    """V5 on a stored table: two batches of upserts in turn, then the stored chunk
    entries and the documents' versions (entry '')."""
    opts = options(F256)
    info = materialize(document_info_table(prepare(corpus(spark, sf_dir), opts), opts, "m"), "document_info")
    root = scratch_path(spark, "document-store")
    create_document_store(info.select("id", "version_id"), document_chunk_entries(info), root)
    docs = info.select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"))

    def updates(rows, mark, chunk, fields):
        return rows.select(
            "doc_id", "seq", F.md5(F.concat(F.col("doc_id"), F.lit(f"|{mark}"), F.col("seq").cast("string"))).alias("version_id"),
            F.concat(F.col("doc_id"), F.lit("-chunk-"), chunk.cast("string")).alias("chunk_id"), fields.alias("fields"),
        )

    seq = F.col("seq").cast("string")
    first = updates(docs.where(F.col("seq") <= _key(F.col("doc_id"), 3)), "dv", F.col("seq") * 2,
                    F.create_map(F.lit("reviewed"), seq, F.lit("tokens"), F.lit("0")))
    apply_upserts(spark, root, first, "2024-01-03 00:00:00")
    second = updates(docs.where(_key(F.col("doc_id"), 2) == 0), "ew", F.col("seq") + 1, F.create_map(F.lit("second"), seq))
    apply_upserts(spark, root, second, "2024-01-04 00:00:00")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return read_store(spark, root).select("doc_id", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "version_id", text.alias("fields_text"))


def q_lookup_stored(spark, sf_dir):
    """The first chunk of every labelled document, from a stored table of
    which only the files of those ids are read."""
    root = _chunk_store(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("-chunk-1")).alias("id"))
    return lookup_store(spark, root, ids).select("id", "doc_id", *_bigint("number", "tokens"), "content_hash", *_bigint("character_count"))


def _journal_imports(spark, sf_dir, sources: list, together: bool) -> str:
    """Imports into one new folder; a source without rows fails."""
    out = scratch_path(spark, "import")

    def work(i):
        opts = replace(options(1.0), run_id=f"r{i + 1}", run_ts=f"2024-01-0{i + 1} 00:00:00")
        try:
            run_import(spark, sources[i], out, opts, keep_source=False)
        except ValueError as exc:  # recorded in the journal, which is what is asked for
            log.info("import %s: %s", opts.run_id, exc)

    if together:
        with ThreadPoolExecutor(len(sources)) as pool:
            list(pool.map(work, range(len(sources))))
    else:
        for i in range(len(sources)):
            work(i)
    return out


def _documents_and_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def q_import_journal(spark, sf_dir):
    """Documents, then a source without rows, which fails, then
    benchmark items into one folder: every state of every run."""
    docs, items = _documents_and_items(spark, sf_dir)
    out = _journal_imports(spark, sf_dir, [docs, docs.where("doc_id is null and doc_id is not null"), items], together=False)
    totals = [F.coalesce(F.col(f"totals.{c}"), F.lit(-1)).alias(c) for c in ("document_count", "total_chunks", "total_tokens")]
    return read_runs(spark, out).select(
        "version", *_bigint("run_seq", "attempt"), "run_id", "status", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(F.col("duration") > 0, F.lit(False)).alias("has_duration"), *totals,
    )


def q_concurrent_imports(spark, sf_dir):
    """K5 / V7: documents and benchmark items imported at the same time into one
    folder; the manifest's totals, and what readers of its tables find."""
    docs, items = _documents_and_items(spark, sf_dir)
    out = _journal_imports(spark, sf_dir, [docs, items], together=True)
    header, entries = read_manifest(spark, out)
    seen = entries.agg(F.count("*").alias("entries"), F.count_distinct("doc_id").alias("documents"), F.sum("total_tokens").alias("entry_tokens"))
    chunks = read_table(spark, out, "chunks").agg(F.count("*").alias("chunk_rows"), F.sum("tokens").cast("bigint").alias("chunk_tokens"))
    totals = header.select("document_count", "total_chunks", "total_tokens", "content_hashes_xor")
    # One row each; together one row.
    figures = totals.unionByName(seen, allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)
    return figures.agg(*[F.max(c).alias(c) for c in figures.columns])


def q_rule_encode(spark, sf_dir):
    """C5 + C6 (parity form): rule-based token ids; decode joins ids with ' '."""
    c = get_counter("regex")
    enc = corpus(spark, sf_dir).select("doc_id", c.encode(F.col("text")).alias("ids"))
    return enc.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.md5(c.decode(F.col("ids"))).alias("decoded_ids_md5"),
        F.get("ids", F.lit(0)).alias("first_id"),
    )


def q_vocabulary_decode(spark, sf_dir):
    """C6 (vocabulary form): decode ids through the corpus vocabulary table."""
    c = corpus(spark, sf_dir)
    enc = c.select("doc_id", get_counter("regex").encode(F.col("text")).alias("ids"))
    enc = enc.withColumn("n_tokens", F.size("ids").cast("bigint"))
    vocab = materialize(vocabulary(c), "vocabulary")  # a stored table, so Spark knows its size
    # Only digests meet, and the texts are encoded and decoded once.
    dec = decode_with_vocabulary(enc, vocab, keep=("n_tokens",))
    digests = materialize(dec.select("doc_id", F.md5("decoded").alias("decoded_md5"), "n_tokens"), "digests")
    return digests.drop("n_tokens").join(digests.drop("decoded_md5"), "doc_id").select("doc_id", "decoded_md5", "n_tokens")


def q_vocabulary_ids(spark, sf_dir):
    """C5 + C6 (integer form): a vocabulary of all documents, stored; the documents
    encoded by it to dense ids and decoded again."""
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    root = scratch_path(spark, "vocabulary")
    extend_vocabulary(docs, root)
    vocab = read_vocabulary(spark, root)
    enc = materialize(encode_texts(docs, vocab), "encoded")
    n = enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))
    # Only digests meet: a projection is not moved below a join by itself.
    dec = decode_texts(enc, vocab).select("doc_id", F.md5("decoded").alias("decoded_md5"))
    return n.join(dec, "doc_id").select("doc_id", "n_ids", "ids_md5", "decoded_md5")


def q_vocabulary_extended(spark, sf_dir):
    """C5 over runs: the vocabulary of all documents, then extended by all
    conversation turns and benchmark items: earlier ids stay, new tokens follow."""
    root = scratch_path(spark, "vocabulary")
    extend_vocabulary(corpus(spark, sf_dir), root)
    turns = table(spark, sf_dir, "conversations").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    extend_vocabulary(spread(turns), root)
    earlier = read_vocabulary(spark, root, version=0).select("token", "id", F.lit(0).alias("version"))
    added = read_vocabulary(spark, root).join(earlier.select("id"), "id", "left_anti").select("token", "id", F.lit(1).alias("version"))
    return earlier.unionByName(added).select("token", *_bigint("id", "version"))


def _bpe():
    return get_counter("bpe", encoding="byte_bpe_50k", on_special="text")


def q_bpe_counts(spark, sf_dir):
    """C1 + C3 + C4: BPE count, encode and the decode round trip per document."""
    c = _bpe()
    enc = corpus(spark, sf_dir).select("doc_id", "text", c.encode(F.col("text")).alias("ids"))
    return enc.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("bpe_tokens"),
        (c.decode(F.col("ids")) == F.col("text")).alias("round_trip"),
    )


def q_chunks_bpe(spark, sf_dir):
    """T6 with the BPE counter (C1 inside the packer and for the recount)."""
    opts = options(F256, counter="bpe", on_special="text", extra={"encoding": "byte_bpe_50k"})
    prepared = prepare(corpus(spark, sf_dir), opts)
    return flat_chunks(chunks_table(prepared, opts))


def queries() -> dict[str, QueryFn]:
    return {
        "chunks_greedy_64": q_chunks(),
        "chunks_greedy_256": q_chunks(F256),
        "chunks_greedy_8192": q_chunks(1.0),
        "chunks_greedy_document_order_64": q_chunks(order="document"),
        "chunks_greedy_catalyst_64": q_chunks(engine="catalyst"),
        "chunks_greedy_catalyst_8": q_chunks(F8, engine="catalyst"),
        "chunks_lossless_64": q_chunks(splitter="lossless"),
        "chunks_lossless_catalyst_8": q_chunks(F8, splitter="lossless", engine="catalyst"),
        "chunks_pages_64": q_chunks(name="pages", id_col="page_id", text_col="html"),
        "chunks_benchmark_64": q_chunks(name="benchmark", id_col="item_id"),
        "chunks_conversations_64": q_conversation_chunks,
        "chunks_sentence_64": q_sentence_chunks(F64),
        "chunks_sentence_8": q_sentence_chunks(F8),
        "chunks_sentence_catalyst_8": q_sentence_chunks(F8, engine="catalyst"),
        "sentences_dot": q_sentences("dot"),
        "sentences_lossless": q_sentences("lossless"),
        "sentences_punct": q_sentences("punct"),
        "token_counts": q_token_counts,
        "document_info_64": q_document_info,
        "processing_state_64": q_processing_state,
        "import_summary_64": q_import_summary,
        "verify_strict_64": q_verify("strict"),
        "verify_lenient_64": q_verify("lenient"),
        "verify_token_64": q_verify("token"),
        "verification_summary_64": q_verification_summary,
        "reimport_verify_strict": q_reimport_verify,
        "lookup_chunk": q_lookup_chunk,
        "lookup_document": q_lookup_document,
        "manifest_entries_64": q_manifest_entries,
        "processing_state_mixed_64": q_processing_state_mixed,
        "import_summary_mixed_64": q_import_summary_mixed,
        "document_models": q_document_models,
        "versions_64": q_versions,
        "processing_runs_64": q_processing_runs,
        "manifest_append_64": q_manifest_append,
        "records_update_256": q_records_update,
        "records_delete_256": q_records_delete,
        "document_upsert_256": q_document_upsert,
        "records_apply_batches_256": q_records_apply,
        "documents_apply_upserts_256": q_documents_apply,
        "lookup_stored_chunks_256": q_lookup_stored,
        "import_journal": q_import_journal,
        "concurrent_imports": q_concurrent_imports,
        "rule_encode": q_rule_encode,
        "vocabulary_decode": q_vocabulary_decode,
        "vocabulary_ids": q_vocabulary_ids,
        "vocabulary_extended": q_vocabulary_extended,
        "bpe_counts": q_bpe_counts,
        "chunks_bpe_256": q_chunks_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "chunks_greedy_64": oracle.chunks_sql(64),
        "chunks_greedy_256": oracle.chunks_sql(256),
        "chunks_greedy_8192": oracle.chunks_sql(8192),
        "chunks_greedy_document_order_64": oracle.chunks_sql(64, order="document"),
        "chunks_greedy_catalyst_64": oracle.chunks_sql(64),
        "chunks_greedy_catalyst_8": oracle.chunks_sql(8),
        "chunks_lossless_64": oracle.chunks_sql(64, splitter="lossless"),
        "chunks_lossless_catalyst_8": oracle.chunks_sql(8, splitter="lossless"),
        "chunks_pages_64": oracle.chunks_sql(64, table="pages", id_col="page_id", text_col="html", prefix="pages"),
        "chunks_benchmark_64": oracle.chunks_sql(64, table="benchmark", id_col="item_id", prefix="benchmark"),
        "chunks_conversations_64": oracle.chunks_sql(
            64, norm="norm AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id, "
            "'conversations/' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '.txt' AS path, "
            "regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM conversations)"
        ),
        "chunks_sentence_64": oracle.sentence_chunks_sql(64),
        "chunks_sentence_8": oracle.sentence_chunks_sql(8),
        "chunks_sentence_catalyst_8": oracle.sentence_chunks_sql(8),
        "sentences_dot": oracle.sentences_sql("dot"),
        "sentences_lossless": oracle.sentences_sql("lossless"),
        "sentences_punct": oracle.sentences_sql("punct"),
        "token_counts": oracle.token_counts_sql(),
        "document_info_64": oracle.document_info_sql(64),
        "processing_state_64": oracle.processing_state_sql(64),
        "import_summary_64": oracle.import_summary_sql(64),
        "verify_strict_64": oracle.verify_sql(64, "strict"),
        "verify_lenient_64": oracle.verify_sql(64, "lenient"),
        "verify_token_64": oracle.verify_sql(64, "token"),
        "verification_summary_64": oracle.verification_summary_sql(64),
        "reimport_verify_strict": oracle.reimport_verify_sql(64),
        "lookup_chunk": oracle.lookup_chunk_sql(64),
        "lookup_document": oracle.lookup_document_sql(64),
        "manifest_entries_64": oracle.manifest_entries_sql(64),
        "processing_state_mixed_64": oracle.processing_state_sql(64, oracle.mixed_norm()),
        "import_summary_mixed_64": oracle.import_summary_sql(64, oracle.mixed_norm()),
        "document_models": oracle.document_models_sql(1 / 128),
        "versions_64": oracle.versions_sql(64),
        "processing_runs_64": oracle.processing_runs_sql(64),
        "manifest_append_64": oracle.manifest_append_sql(64),
        "records_update_256": oracle.records_update_sql(256),
        "records_delete_256": oracle.records_delete_sql(256),
        "document_upsert_256": oracle.document_upsert_sql(256),
        "records_apply_batches_256": oracle.records_apply_sql(256),
        "documents_apply_upserts_256": oracle.documents_apply_sql(256),
        "lookup_stored_chunks_256": oracle.lookup_chunk_sql(256),
        "import_journal": oracle.import_journal_sql(8192),
        "concurrent_imports": oracle.concurrent_imports_sql(8192),
        "rule_encode": oracle.rule_encode_sql(),
        "vocabulary_decode": oracle.vocabulary_decode_sql(),
        "vocabulary_ids": oracle.vocabulary_ids_sql(),
        "vocabulary_extended": oracle.vocabulary_extended_sql(),
        # bpe_counts, chunks_bpe_256: no BPE in DuckDB -> rows-only check; the
        # tests compare them with the same counter run outside Spark.
    }
