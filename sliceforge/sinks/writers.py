"""Sinks (K1-K7): tables instead of one JSON file per record.

Chunks are written sorted by ``doc_id`` within each task's file (parquet
row-group statistics then let point lookups skip data) instead of one folder
per document; JSON export writes
JSON Lines (splittable) rather than indented files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", run_seq: int | None = None) -> str:
    """Writes a table, or a run's partition of it.

    A partition is written as a folder of its own, so runs that write at the same
    time do not share a job's temporary files."""
    path = os.path.join(root, name)
    if run_seq is not None:
        path = os.path.join(path, f"run_seq={run_seq}")
        df = df.drop("run_seq")
    df.write.mode(mode).parquet(path)
    return path


def write_chunks(chunks: DataFrame, root: str, mode: str = "append", run_seq: int | None = None) -> str:
    """K2: chunk text and metadata together.

    Each task writes one file, sorted by ``(doc_id, number)`` (a local sort,
    no shuffle): a lookup by document or chunk id reads only the row groups
    whose min/max statistics can hold it.  Hash-bucket folders would instead
    make every task write a small file into every bucket.
    """
    return write_table(chunks.sortWithinPartitions("doc_id", "number"), root, "chunks", mode, run_seq)


ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_json(df: DataFrame, path: str, mode: str = "overwrite", pretty: bool = False) -> None:
    """K7: JSON records, timestamps as ISO-8601 strings.

    Default: JSON Lines (splittable, readable back with :func:`read_json_records`).
    ``pretty=True``: each record indented over several lines, for people;
    read back with ``multiLine``-style tooling, not as JSON Lines.
    """
    if not pretty:
        df.write.mode(mode).option("timestampFormat", ISO_TS).json(path)
        return
    opts = {"pretty": "true", "timestampFormat": ISO_TS}
    df.select(F.to_json(F.struct(*df.columns), opts).alias("value")).write.mode(mode).text(path)


def export_chunk_texts(chunks: DataFrame, path: str) -> None:
    """Optional plain-text export of chunk bodies: one text file per task,
    in document and chunk order (Spark's text sink; not one file per chunk)."""
    chunks.sortWithinPartitions("doc_id", "number").select("text").write.mode("overwrite").text(path)
