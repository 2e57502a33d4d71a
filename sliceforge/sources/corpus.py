"""Corpus sources (S1-S4, P7): a documents table or a tree of ``.txt`` files.

Both produce the same frame: ``doc_id, filename, path, text, decode_error``
with text decoded and newline-normalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceforge.functions.text import normalize_newlines
from sliceforge.operators.validate import decode_utf8
from sliceforge.sources.listing import list_files, read_files

CORPUS_COLUMNS = ["doc_id", "filename", "path", "text", "decode_error"]


def corpus_from_table(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "documents", run: str | None = None
) -> DataFrame:
    """A table of texts as a corpus; ``filename`` is ``<id>.txt``.

    With ``run`` every row gets a document id of its own for that run (P7), as a
    file does, and the table's id stays as ``source_id``: importing a table again
    makes new documents.  Without it the table's id is the document id.
    """
    source_id = F.col(id_col).cast("string")
    filename = F.concat(source_id, F.lit(".txt"))
    path = F.concat(F.lit(prefix + "/"), filename)
    return df.select(
        *([] if run is None else [source_id.alias("source_id")]),
        (source_id if run is None else F.md5(F.concat_ws("|", path, F.lit(run)))).alias("doc_id"),
        filename.alias("filename"),
        path.alias("path"),
        normalize_newlines(F.col(text_col)).alias("text"),
        F.lit(None).cast("string").alias("decode_error"),
    )


def assign_doc_id(path, run_id: str):
    """Deterministic document id per (file, run): two runs make two documents,
    and a task that is computed again makes the same ids."""
    return F.md5(F.concat(path, F.lit("\u0000"), F.lit(run_id)))


def _locate(spark: SparkSession, location: str) -> tuple[str, str, int]:
    """``dir``, ``file`` or ``missing``, the path with its scheme and its bytes,
    through Hadoop's FileSystem (hdfs://, s3a://, file:)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.makeQualified(path).toString()
    if not fs.exists(path):
        return "missing", whole, 0
    status = fs.getFileStatus(path)
    return "dir" if status.isDirectory() else "file", whole, status.getLen()


def scan_corpus(spark: SparkSession, location: str, run_id: str = "run-0") -> DataFrame:
    """Read ``.txt`` files below a folder, or one ``.txt`` file.

    Case-sensitive ``*.txt`` suffix, recursive, whatever the name begins with.
    Folders are listed and files read by tasks (see ``sources.listing``).  Empty
    files are rows with an empty text, which fail as empty later on; a file that
    cannot be read is a row with an error.
    """
    kind, whole, size = _locate(spark, location)
    if kind == "dir":
        files = list_files(spark, whole, ".txt")
        found = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        if not found["n"]:  # S3
            raise ValueError(f"{location}: holds no .txt file")
        size = found["size"]
    elif kind == "file" and location.endswith(".txt"):
        files = spark.createDataFrame([(whole, size)], "path string, size long")
    else:
        raise ValueError(f"{location}: expected a folder or a file with the suffix .txt")
    raw = read_files(files, size)
    text, error = decode_utf8(F.col("content"))
    return raw.select(
        assign_doc_id(F.col("path"), run_id).alias("doc_id"),
        F.element_at(F.split(F.col("path"), "/"), -1).alias("filename"),
        F.col("path"),
        text.alias("text"),
        F.coalesce("read_error", error).alias("decode_error"),
    )
