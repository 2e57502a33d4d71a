"""Change batches applied to stored records (V2-V5 on tables).

A batch is a table of changes.  For chunk records: (action, id, seq, version_id,
fields) with action ``create`` (fields are the new record's columns), ``update``
(as in ``operators.records``) or ``delete``; a batch creates first, then updates,
then deletes.  For document records: (doc_id, seq, version_id, chunk_id, fields),
upserts of chunk entries.  Each batch is one commit of the store: readers see all
of it or nothing, and only the files of the ranges it touches are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceforge.operators.records import (
    FIXED_COLUMNS,
    MAP_COLUMNS,
    RecordError,
    create_chunk_records,
    created_history,
    delete_records,
    insert_records,
    update_records,
    upsert_document_chunks,
)
from sliceforge.session import materialize
from sliceforge.sinks.record_store import TARGET_ROWS, create_store, merge_store

ACTIONS = ("create", "update", "delete")


def create_chunk_store(chunks: DataFrame, root: str, ts: str, target_rows: int = TARGET_ROWS) -> dict:
    """A store of the chunk records of an import, with their ``created`` history."""
    records = create_chunk_records(chunks, ts)
    return create_store(records, root, "id", target_rows, created_history(records, ts))


def new_records(creates: DataFrame, records: DataFrame, ts: str) -> DataFrame:
    """Records of ``create`` changes: fields that name a column are cast to it, a
    map column is JSON text, other fields are open attributes."""
    cols = []
    for f in records.schema:
        value = F.col("fields")[f.name]
        if f.name in ("id", "version_id"):
            cols.append(F.col(f.name))
        elif f.name == "created_at":
            cols.append(F.to_timestamp(F.lit(ts)).alias("created_at"))
        elif f.name == "parent_version_id":
            cols.append(F.lit(None).cast("string").alias("parent_version_id"))
        elif f.name in MAP_COLUMNS:
            cols.append(F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>")).alias(f.name))
        elif f.name == "attributes":
            cols.append(F.map_filter("fields", lambda k, v: ~k.isin(*records.columns)).alias("attributes"))
        else:
            cols.append(value.try_cast(f.dataType.simpleString()).alias(f.name))
    return creates.select(*cols)


def apply_changes(spark: SparkSession, root: str, changes: DataFrame, ts: str, check: bool = True) -> dict:
    """One batch of creates, updates and deletes, committed to a chunk store.

    With ``check`` an unknown action, a create of an existing id, an update of a
    missing one, a bad ``seq`` or a value that does not fit raise, and nothing is
    committed.  Ids to delete that do not exist are counted (``missing``), not an
    error.  ``seq`` counts from 1 among a record's updates of the batch.
    """
    changes = materialize(changes, "changes")  # read by the checks and by every attempt
    if check:
        bad = changes.where(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))).limit(1).collect()
        if bad:
            raise RecordError(f"unknown action {bad[0].action!r}")
        fixed = F.arrays_overlap(F.map_keys("fields"), F.array(*map(F.lit, [c for c in FIXED_COLUMNS if c != "attributes"])))
        if not changes.where((F.col("action") == "create") & fixed).isEmpty():
            raise RecordError("fields may not set id or version_id")
    of = lambda action: changes.where(F.col("action") == action)
    gone = {}

    def rewrite(records: DataFrame) -> tuple[DataFrame, DataFrame]:
        created = new_records(of("create"), records, ts)
        present = insert_records(records, created, check)
        updates = of("update").select(F.col("id").alias("record_id"), "seq", "version_id", "fields")
        updated, history, _ = update_records(present, updates, ts, check)
        kept, missing = delete_records(updated, of("delete"))
        gone["missing"] = missing
        return kept, created_history(created, ts).unionByName(history)

    result = merge_store(spark, root, changes.select("id").distinct(), rewrite)
    return {**result, "missing": gone["missing"].count() if gone else 0}


def create_document_store(doc_versions: DataFrame, entries: DataFrame, root: str, target_rows: int = TARGET_ROWS) -> dict:
    """A store of document records: one row per document (chunk_id null) with its
    version, and one per entry of its chunk list."""
    return create_store(_document_rows(doc_versions, entries), root, "doc_id", target_rows)


def _document_rows(doc_versions: DataFrame, entries: DataFrame) -> DataFrame:
    heads = doc_versions.select(
        F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), "version_id",
        F.lit(None).cast("map<string,string>").alias("fields"),
    )
    lines = entries.select("doc_id", "chunk_id", F.lit(None).cast("string").alias("version_id"), "fields")
    return heads.unionByName(lines)


def apply_upserts(spark: SparkSession, root: str, updates: DataFrame, ts: str, check: bool = True) -> dict:
    """V5 on a stored table: a batch of upserts of chunk entries, as one commit."""
    updates = materialize(updates, "upserts")

    def rewrite(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        docs = rows.where("chunk_id is null").select(F.col("doc_id").alias("id"), "version_id")
        entries = rows.where("chunk_id is not null").select("doc_id", "chunk_id", "fields")
        merged, history, versions = upsert_document_chunks(docs, entries, updates, ts, check)
        return _document_rows(versions, merged), history

    return merge_store(spark, root, updates.select("doc_id").distinct(), rewrite)
