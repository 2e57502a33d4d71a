"""Files below a folder, listed and read by tasks.

The driver holds the folder's name and counts, never a list of files: folders
are dealt to tasks, which descend into them and hand the folders that they do
not reach to the next round.  Tasks reach the files through pyarrow's file
systems (``file``, ``hdfs``, ``s3`` / ``s3a``, ``gs``, ``abfs``), so empty files
and names that Spark's readers take as hidden (``.x``, ``_x``) are like others.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceforge.session import materialize

ENTRIES_SCHEMA = "path string, size long, is_dir boolean"
#: Entries that a task lists before it leaves further folders to the next round.
DESCEND_ENTRIES = 20_000
#: Bytes of files that a task reads, and bytes in one batch of rows.
TASK_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
#: A row of a Spark table holds at most 2 GB.
MAX_FILE_BYTES = (1 << 31) - (1 << 16)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str, Callable[[str], str]]:
    """File system of a Hadoop path, the path in it, and the way back to a URI."""
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/"), lambda p: f"file:{p}"
    authority, _, path = rest.removeprefix("//").partition("/")
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, base = pafs.FileSystem.from_uri(f"{known}://{authority}/")
    base = base.rstrip("/")
    return system, f"{base}/{path}", lambda p: f"{scheme}://{authority}{p[len(base):]}"


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, is a folder) of what is in a folder.  Links to folders are not
    followed, so a link to a parent does not go round."""
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, 0, True
                elif entry.is_file():
                    yield entry.path, entry.stat().st_size, False
    else:
        for info in system.get_file_info(pafs.FileSelector(folder)):
            if info.type in (pafs.FileType.Directory, pafs.FileType.File):
                yield info.path, info.size or 0, info.type == pafs.FileType.Directory


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, sizes, dirs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(dirs, pa.bool_())], ["path", "size", "is_dir"]
    )


def _lister(suffix: str, descend: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("path").to_pylist():
                system, top, back = _filesystem(start)
                todo, seen, rows = [top], 0, []
                while todo:
                    folder = todo.pop()
                    if seen >= descend:
                        rows.append((back(folder), 0, True))
                    else:
                        for path, size, is_dir in _entries(system, folder):
                            seen += 1
                            if is_dir:
                                todo.append(path)
                            elif path.endswith(suffix):
                                rows.append((back(path), size, False))
                            if len(rows) >= 10_000:
                                yield _batch(rows)
                                rows = []
                if rows:
                    yield _batch(rows)

    return run


def list_files(spark: SparkSession, folder: str, suffix: str = "", descend: int = DESCEND_ENTRIES) -> DataFrame:
    """``(path, size)`` of all files below a folder (a Hadoop path with its scheme)
    whose name ends with ``suffix``.

    One round of tasks per some levels of a large tree; each writes what it found
    to the shared folder, and its open folders are dealt out again.  One folder is
    listed by one task, on a local or mounted file system as a stream.
    """
    rounds = []
    open_folders = spark.createDataFrame([(folder,)], "path string")
    while True:
        found = materialize(open_folders.mapInArrow(_lister(suffix, descend), ENTRIES_SCHEMA), "listing")
        rounds.append(found.where("not is_dir").select("path", "size"))
        left = found.where("is_dir").select("path")
        if left.isEmpty():
            break
        open_folders = left.repartition(max(spark.sparkContext.defaultParallelism, 2), "path")
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: list[str] = []
    contents: list[bytes | None] = []
    errors: list[str | None] = []
    held = 0

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["path", "content", "read_error"])

    for batch in batches:
        for uri, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if held and (held + size > BATCH_BYTES or len(paths) >= 1_000):
                yield flush()
                paths, contents, errors, held = [], [], [], 0
            data, error = None, None
            try:
                if size > MAX_FILE_BYTES:
                    raise OSError(f"file of {size} bytes is larger than a row")
                system, path, _ = _filesystem(uri)
                with system.open_input_stream(path) as stream:
                    data = stream.read()
            except OSError as exc:  # this file fails; the others are read
                error = f"can't read the file: {exc}"
            paths.append(uri)
            contents.append(data)
            errors.append(error)
            held += 1 + (len(data) if data else 0)
    if paths:
        yield flush()


def read_files(files: DataFrame, total_bytes: int) -> DataFrame:
    """``(path, content, read_error)`` of listed files; only paths are shuffled.
    A file that is gone or cannot be read is a row with an error."""
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-total_bytes // TASK_BYTES))
    dealt = files.select("path", "size").repartition(parts, F.col("path"))
    return dealt.mapInArrow(_contents, "path string, content binary, read_error string")
