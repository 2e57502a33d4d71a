"""Readers of the job's own tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _path(root: str, name: str) -> str:
    return os.path.join(root, name)


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(_path(root, name))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the job; of a table with runs the completed ones."""
    from sliceforge.plans.journal import visible

    df = spark.read.parquet(_path(root, name))
    shown = visible(spark, root) if "run_seq" in df.columns else None
    return df if shown is None else df.where(shown)


def read_run(spark: SparkSession, root: str, name: str, run_seq: int) -> DataFrame:
    """One run's partition, whether or not the run has completed."""
    df = spark.read.parquet(os.path.join(_path(root, name), f"run_seq={run_seq}"))
    return df.withColumn("run_seq", F.lit(run_seq))


def read_document_info(spark: SparkSession, root: str) -> DataFrame:
    """Every document record of every past run."""
    return read_table(spark, root, "document_info")


def read_chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    """The stored chunk bodies, pruned to what verification needs."""
    return read_table(spark, root, "chunks").select("id", "doc_id", "text", "run_seq")


def read_chunk(spark: SparkSession, root: str, chunk_id: str) -> DataFrame:
    """One chunk by id.  Both filters reach the parquet scan; files are
    sorted by doc_id, so row groups that cannot hold the document are skipped."""
    doc_id = chunk_id.rsplit("-chunk-", 1)[0]
    df = read_table(spark, root, "chunks")
    return df.where((F.col("doc_id") == doc_id) & (F.col("id") == chunk_id))


def read_document(spark: SparkSession, root: str, doc_id: str) -> DataFrame:
    """One document record by id."""
    return read_document_info(spark, root).where(F.col("id") == doc_id)


def read_json_records(spark: SparkSession, path: str, schema, mode: str = "PERMISSIVE") -> DataFrame:
    """JSON records with an explicit schema.  PERMISSIVE keeps malformed
    records as ``_corrupt_record`` (the reference's "None + error log");
    FAILFAST raises (the manifest's behaviour)."""
    from pyspark.sql.types import StringType, StructField, StructType

    if mode == "PERMISSIVE":
        schema = StructType(list(schema.fields) + [StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


HEADER_SCHEMA = (
    "manifest_id string, created_at timestamp, updated_at timestamp, document_count long, total_chunks long, total_tokens long, "
    "model_name string, latest_version_id string, content_hashes_xor string, metadata map<string,string>, run_seq int"
)


def read_manifest(spark: SparkSession, root: str):
    """The current manifest header (one row) and the entries of completed runs,
    or ``(None, None)`` when there is none yet (a new manifest is then started)."""
    from sliceforge.plans.journal import run_log

    last = run_log(spark, root).last()
    if last is None or last["header"]["run_seq"] is None:
        return None, None
    row = {**last["header"], "metadata": {}}
    text = spark.createDataFrame([(json.dumps(row),)], "value string")
    formats = {"timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
    header = text.select(F.from_json("value", HEADER_SCHEMA, formats).alias("h")).select("h.*")
    return header, read_table(spark, root, "manifest_entries")
