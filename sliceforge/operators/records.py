"""Record services as batch operators.

The reference edits one JSON file at a time under a file lock.  Here a batch
of changes (a DataFrame) is applied to a table and written as a new version
of it.  A record may have a third of all changes, so changes of a record are not
brought together as rows:

* a change batch carries a dense ``seq`` (1, 2, ...) per record; the parent
  of change ``s`` is found with an equi-join on ``(key, s)``, the record's own
  version standing in as change 0, so a record changed a million times is spread
  over many tasks (no window, no group);
* final values come from ``max(seq)`` (a hash aggregate, combined map-side)
  joined back on the unique ``(key, seq)``;
* records are checked to exist against the aggregated ids, one row per record;
* version history lives in its own table (one row per version) instead of an
  ever-growing nested array in the record.

Changes are ``(chunk_id, seq, version_id, fields map<string,string>)``.  A key
``llm_analysis.<k>`` / ``llm_entity_extraction.<k>`` sets a key of that map,
a column name overwrites the whole column (a map as JSON text; null sets null),
other keys go to the open ``attributes`` map.  ``id`` and ``version_id`` may not
be set through ``fields`` (the chain of versions would break).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_COLUMNS = ("llm_analysis", "llm_entity_extraction")
#: Columns that changes do not reach by name.
FIXED_COLUMNS = ("id", "version_id", "attributes")

HISTORY_COLUMNS = ["record_id", "seq", "version_id", "parent_version_id", "timestamp", "action", "details"]


class RecordError(ValueError):
    pass


def merge_maps(old: Column, new: Column) -> Column:
    """``old`` updated with ``new`` (later wins), whatever the session's
    ``spark.sql.mapKeyDedupPolicy``: the old keys that ``new`` lacks, found by one
    set difference, then all of ``new``."""
    kept = F.array_except(F.map_keys(old), F.map_keys(new))
    return F.map_concat(F.map_from_arrays(kept, F.transform(kept, lambda k: F.element_at(old, k))), new)


def _ts(ts: str | Column) -> Column:
    return ts if isinstance(ts, Column) else F.to_timestamp(F.lit(ts))


def create_chunk_records(chunks: DataFrame, ts: str, version_of: Column | None = None) -> DataFrame:
    """V2 (building the records): ``ChunkMetadata`` rows from chunk rows."""
    vid = version_of if version_of is not None else F.md5(F.concat(F.lit("created|"), F.col("id")))
    return chunks.select(
        "id",
        "number",
        "tokens",
        F.col("doc_id").cast("string").alias("doc_id"),
        "content_hash",
        "character_count",
        _ts(ts).alias("created_at"),
        F.create_map().cast("map<string,string>").alias("llm_analysis"),
        F.create_map().cast("map<string,string>").alias("llm_entity_extraction"),
        F.create_map().cast("map<string,string>").alias("attributes"),
        vid.alias("version_id"),
        F.lit(None).cast("string").alias("parent_version_id"),
    )


def created_history(records: DataFrame, ts: str) -> DataFrame:
    """The ``created`` history row of each new record (parent null, no details)."""
    return records.select(
        F.col("id").alias("record_id"),
        F.lit(0).alias("seq"),
        "version_id",
        F.lit(None).cast("string").alias("parent_version_id"),
        _ts(ts).alias("timestamp"),
        F.lit("created").alias("action"),
        F.lit(None).cast("map<string,string>").alias("details"),
    )


def insert_records(existing: DataFrame, new: DataFrame, check: bool = True) -> DataFrame:
    """V2: insert; an id that exists already, or twice in the batch, is an error."""
    if check:
        ids = new.groupBy("id").agg(F.count("*").alias("n"))
        known = existing.select("id", F.lit(True).alias("known"))
        clash = ids.join(known, "id", "left").where("known or n > 1").select("id").limit(5).collect()
        if clash:
            raise RecordError(f"Chunk(s) already exist: {', '.join(str(r.id) for r in clash)}")
    return existing.unionByName(new)


def get_records(records: DataFrame, ids: DataFrame | list) -> DataFrame:
    """Point or batch lookup by id (a semi join; missing ids
    simply have no row, the reference's ``None``)."""
    if isinstance(ids, list):
        return records.where(F.col("id").isin(ids))
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def last_by_seq(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Value of the highest ``seq`` per key, with that ``seq``.

    ``max(seq)`` is a hash aggregate with map-side partial results; the value
    is fetched back with an equi-join on the unique ``(keys, seq)``.  (A
    ``max_by`` over a string would force a sort-based aggregate.)
    """
    top = df.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return top.join(df.select(*keys, "seq", F.col(value).alias(alias)), [*keys, "seq"])


def check_dense_seq(changes: DataFrame, key: str) -> None:
    """``seq`` must run 1..n per record (partial aggregates only)."""
    bad = changes.groupBy(key).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")).where(
        (F.col("lo") != 1) | (F.col("hi") != F.col("n"))
    )
    if not bad.isEmpty():
        raise RecordError(f"change seq numbers must be 1..n per {key}")


def chain_versions(changes: DataFrame, key: str, base_versions: DataFrame) -> DataFrame:
    """Parent of each change: the version of the change before it, or for the
    first the record's version before the batch (change 0).  The join key holds
    ``seq``, so the changes of one record spread."""
    before = changes.select(F.col(key), (F.col("seq") + 1).alias("seq"), F.col("version_id").alias("parent_version_id"))
    base = base_versions.select(F.col("id").alias(key), F.lit(1).alias("seq"), F.col("version_id").alias("parent_version_id"))
    return changes.join(before.unionByName(base), [key, "seq"], "left")


def _not_a(fields: Column, name: str, kind: str) -> Column:
    """1 where ``fields`` sets ``name`` to a text that is no ``kind``."""
    value = fields[name]
    return (value.isNotNull() & value.try_cast(kind).isNull()).cast("int")


def validate_changes(changes: DataFrame, records: DataFrame, key: str = "record_id") -> None:
    """All checks of a change batch in one job: ``id`` and ``version_id`` are not
    set, values fit their columns, ``seq`` is dense 1..n per record, every record
    exists.

    The changes are aggregated per record first (partial results map-side); only
    one row per record meets the record ids.
    """
    typed = [(f.name, f.dataType.simpleString()) for f in records.schema if f.name not in FIXED_COLUMNS and f.name not in MAP_COLUMNS]
    misfits = [F.coalesce(_not_a(F.col("fields"), n, t), F.lit(0)) for n, t in typed if t != "string"]
    misfits += [
        F.coalesce((F.col("fields")[c].isNotNull() & F.from_json(F.col("fields")[c], "map<string,string>").isNull()).cast("int"), F.lit(0))
        for c in MAP_COLUMNS
        if c in records.columns
    ]
    fixed = F.array(F.lit("version_id"), F.lit("id"))
    per_key = changes.groupBy(key).agg(
        F.min("seq").alias("lo"),
        F.max("seq").alias("hi"),
        F.count("*").alias("n"),
        F.sum(F.arrays_overlap(F.map_keys("fields"), fixed).cast("int")).alias("fixed"),
        F.sum(sum(misfits, F.lit(0))).alias("misfits"),
    )
    ids = records.select(F.col("id").alias(key), F.lit(True).alias("_exists"))
    joined = per_key.join(ids, key, "left")
    summary = joined.agg(
        F.coalesce(F.sum("fixed"), F.lit(0)).alias("fixed"),
        F.coalesce(F.sum("misfits"), F.lit(0)).alias("misfits"),
        F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("bad_seq"),
        F.count_if(F.col("_exists").isNull()).alias("missing"),
    ).first()
    if summary.fixed:
        raise RecordError("fields may not set id or version_id")
    if summary.misfits:
        bad = per_key.where("misfits > 0").select(key).limit(5).collect()
        raise RecordError(f"values do not fit their columns, in: {', '.join(str(r[0]) for r in bad)}")
    if summary.bad_seq:
        raise RecordError(f"change seq numbers must be 1..n per {key}")
    if summary.missing:
        missing = joined.where("_exists is null").select(key).limit(5).collect()
        raise RecordError(f"Chunk(s) do not exist: {', '.join(str(r[0]) for r in missing)}")


def update_records(records: DataFrame, changes: DataFrame, ts: str, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V3: apply a batch of changes.

    Returns ``(updated_records, new_history_rows, unmatched_changes)``.  With
    ``check`` a change for a missing record, a bad ``seq`` or a value that does
    not fit its column raises; without it, changes for missing records are
    returned as unmatched and values that do not fit become null.
    """
    changes = changes.withColumnRenamed("chunk_id", "record_id") if "chunk_id" in changes.columns else changes
    ids = records.select(F.col("id").alias("record_id"))
    if check:
        validate_changes(changes, records)
        matched, unmatched = changes, changes.limit(0)
    else:
        matched, unmatched = changes.join(ids, "record_id", "left_semi"), changes.join(ids, "record_id", "left_anti")
    linked = chain_versions(matched, "record_id", records)
    history = linked.select(
        "record_id",
        "seq",
        "version_id",
        "parent_version_id",
        _ts(ts).alias("timestamp"),
        F.lit("updated").alias("action"),
        F.col("fields").alias("details"),
    )
    final_version = last_by_seq(matched, ["record_id"], "version_id", "_new_version").drop("seq")
    # Last value per (record, key) and when it was set; a record's distinct keys
    # come together as its map, the changes do not.
    kv = matched.select("record_id", "seq", F.explode("fields").alias("k", "v"))
    last = last_by_seq(kv, ["record_id", "k"], "v", "v")
    merged = last.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("v", "seq").alias("e")))).alias("_set")
    )
    upd = (
        records.join(final_version.withColumnRenamed("record_id", "id"), "id", "left")
        .join(merged.withColumnRenamed("record_id", "id"), "id", "left")
        .withColumn("_set", F.coalesce("_set", F.create_map().cast("map<string,struct<v:string,seq:int>>")))
    )
    cols = []
    for f in records.schema:
        old, entry = F.col(f.name), F.col("_set")[f.name]
        if f.name == "version_id":
            new = F.coalesce("_new_version", old)
        elif f.name in MAP_COLUMNS:
            new = _set_map(old, F.col("_set"), f.name)
        elif f.name == "attributes":
            new = _set_open(old, F.col("_set"), records.columns)
        elif f.name in FIXED_COLUMNS:
            new = old
        else:
            new = F.when(entry.isNotNull(), entry["v"].try_cast(f.dataType.simpleString())).otherwise(old)
        cols.append(new.alias(f.name))
    return upd.select(*cols), history, unmatched


def _set_map(old: Column, setm: Column, name: str) -> Column:
    """Map column after the changes: the whole map if it was set, then the single
    keys that were set later (``<name>.<key>``)."""
    whole = setm[name]
    keys = F.map_filter(
        setm, lambda k, e: k.startswith(name + ".") & (whole.isNull() | (e["seq"] > whole["seq"]))
    )
    single = F.transform_values(
        F.transform_keys(keys, lambda k, e: F.substring(k, F.lit(len(name) + 2), F.length(k))), lambda k, e: e["v"]
    )
    base = F.when(whole.isNotNull(), F.from_json(whole["v"], "map<string,string>")).otherwise(old)
    return F.when(F.size(keys) == 0, base).otherwise(merge_maps(F.coalesce(base, F.create_map().cast("map<string,string>")), single))


def _set_open(old: Column, setm: Column, columns: list[str]) -> Column:
    """``attributes`` after the changes: keys that name no column."""
    picked = F.map_filter(
        setm, lambda k, e: ~(k.startswith(MAP_COLUMNS[0] + ".") | k.startswith(MAP_COLUMNS[1] + ".") | k.isin(*columns))
    )
    return merge_maps(old, F.transform_values(picked, lambda k, e: e["v"]))


def delete_records(records: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V4: remove by id; ids that do not exist are returned (a warning in the
    reference, not an error)."""
    ids = ids.select("id").distinct()
    return records.join(ids, "id", "left_anti"), ids.join(records.select("id"), "id", "left_anti")


def latest_version(history: DataFrame, key: str = "record_id") -> DataFrame:
    """V6: last history element per record."""
    return last_by_seq(history, [key], "version_id", "version_id").drop("seq")


# --------------------------------------------------------------------------
# Document records (V5): chunk entries as a table keyed by (doc_id, chunk_id)
# --------------------------------------------------------------------------


def document_chunk_entries(document_info: DataFrame) -> DataFrame:
    """The ``chunks`` list of ``DocumentMetadata`` as rows of open maps."""
    rows = document_info.select(F.col("id").alias("doc_id"), F.explode("chunks").alias("c"))
    return rows.select(
        "doc_id",
        F.col("c.id").alias("chunk_id"),
        F.create_map(
            F.lit("number"), F.col("c.number").cast("string"),
            F.lit("tokens"), F.col("c.tokens").cast("string"),
            F.lit("content_hash"), F.col("c.content_hash"),
        ).alias("fields"),
    )


def upsert_document_chunks(
    doc_versions: DataFrame, entries: DataFrame, updates: DataFrame, ts: str, check: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V5: upsert chunk entries into their documents.

    ``updates``: ``(doc_id, seq, version_id, chunk_id, fields)``, dense seq per
    document.  An entry with that chunk id gets the fields merged (later
    updates win); otherwise it is appended.  One ``chunk_updated`` history row
    per update; the document's version becomes the last update's.

    A document that does not exist is an error (with ``check``).

    Returns ``(entries, history_rows, doc_versions)``.
    """
    check_dense_seq(updates, "doc_id")
    if check:
        asked = updates.groupBy("doc_id").agg(F.count("*").alias("n"))
        missing = asked.join(doc_versions.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").limit(5).collect()
        if missing:
            raise RecordError(f"Document(s) not found: {', '.join(str(r.doc_id) for r in missing)}")
    kv = updates.select("doc_id", "chunk_id", "seq", F.explode("fields").alias("k", "v"))
    last_fields = (
        last_by_seq(kv, ["doc_id", "chunk_id", "k"], "v", "v")
        .groupBy("doc_id", "chunk_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_new"))
    )
    merged = entries.join(last_fields, ["doc_id", "chunk_id"], "full_outer").select(
        "doc_id",
        "chunk_id",
        F.when(F.col("fields").isNull(), F.col("_new"))
        .when(F.col("_new").isNull(), F.col("fields"))
        .otherwise(merge_maps(F.col("fields"), F.col("_new")))
        .alias("fields"),
    )
    linked = chain_versions(updates, "doc_id", doc_versions.select(F.col("id"), "version_id"))
    history = linked.select(
        F.col("doc_id").alias("record_id"),
        "seq",
        "version_id",
        "parent_version_id",
        _ts(ts).alias("timestamp"),
        F.lit("chunk_updated").alias("action"),
        merge_maps(F.col("fields"), F.create_map(F.lit("id"), F.col("chunk_id"))).alias("details"),
    )
    final = last_by_seq(updates, ["doc_id"], "version_id", "_v").drop("seq")
    versions = doc_versions.join(final.withColumnRenamed("doc_id", "id"), "id", "left").select(
        "id", F.coalesce("_v", "version_id").alias("version_id")
    )
    return merged, history, versions
