"""Continuous import: new ``.txt`` files in a folder, imported micro-batch by
micro-batch with the same plan as the batch job.

The reference is a batch job; this is the streaming form of its import
(file-source ``readStream`` + ``foreachBatch``), nothing more.  Each
micro-batch is one run (``run_id = <base>-<epoch>``, ``run_seq = base +
epoch``, the base fixed at the stream's first start and kept in its
checkpoint folder); outputs are deterministic per epoch and written with
dynamic partition overwrite, so a replayed epoch after a failure rewrites the
same partitions instead of duplicating rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.operators.validate import decode_utf8
from sliceforge.sources.corpus import assign_doc_id


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_corpus(spark: SparkSession, input_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A streaming corpus of ``*.txt`` files (raw bytes, decoded strictly)."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(input_dir)
    )
    return raw.select("path", "content")


def _batch_runner(output_dir: str, opts: ChunkOptions, run_seq_base: int = 0):
    from sliceforge.plans.run import run_import

    def run(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        run_opts = replace(opts, run_id=f"{opts.run_id}-{epoch_id}")
        text, error = decode_utf8(F.col("content"))
        corpus = batch.select(
            assign_doc_id(F.col("path"), run_opts.run_id).alias("doc_id"),
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            "path",
            text.alias("text"),
            error.alias("decode_error"),
        )
        # run_seq from the epoch: a replayed epoch rewrites its own partitions.
        run_import(batch.sparkSession, corpus, output_dir, run_opts, prepared_corpus=True, run_seq=run_seq_base + epoch_id)

    return run


def _run_seq_base(spark: SparkSession, output_dir: str, checkpoint_dir: str) -> int:
    """The run_seq of epoch 0, fixed when the stream first starts (the next free
    run_seq of the output) and kept in the stream's checkpoint folder, so that
    after a restart a replayed epoch maps to the same run_seq again."""
    from sliceforge.plans.journal import run_log
    from sliceforge.sources.tables import table_exists

    marker = checkpoint_dir.rstrip("/") + "/sliceforge_run_seq_base"
    if table_exists(spark, checkpoint_dir, "sliceforge_run_seq_base"):
        return int(spark.read.text(marker).first()[0])
    last = run_log(spark, output_dir).last()
    base = 0 if last is None else last["next_run_seq"]
    spark.createDataFrame([(str(base),)], "value string").coalesce(1).write.text(marker)
    return base


def start_continuous_import(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    opts: ChunkOptions | None = None,
    trigger_seconds: int | None = None,
    available_now: bool = False,
    run_seq_base: int | None = None,
):
    """Start the streaming import; returns the ``StreamingQuery``."""
    opts = opts or ChunkOptions()
    opts.limit  # validate options before starting
    if run_seq_base is None:
        run_seq_base = _run_seq_base(spark, output_dir, checkpoint_dir)
    writer = stream_corpus(spark, input_dir).writeStream.foreachBatch(_batch_runner(output_dir, opts, run_seq_base)).option(
        "checkpointLocation", checkpoint_dir
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
