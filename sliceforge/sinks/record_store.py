"""A record store: rows in files by range of their key, changed by copy-on-write.

Each range of keys has its own files.  A batch of changes rewrites the files of
the ranges that its keys fall into; all others stay as they are, and a lookup
opens only the files of its keys.  A range that has grown is spread over several
files by a hash of the key.

    <root>/log/<n>.json        commits (see ``commit_log``)
    <root>/files/<batch>/      the live files after a commit: path, lo, parts, part, rows
    <root>/data/<batch>/       rows, one folder per range and part
    <root>/history/<batch>/    history rows of a commit

Writers of one store need not know of each other: data is written first, under a
name of its own, and seen only through the commit.  A writer that finds another
commit before its own repeats its change if the other touched the same ranges,
else it only takes over the other's list of files.

The driver holds one row per *file* (as a scan does to plan itself), never rows.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sliceforge.sinks.commit_log import CommitLog

#: Rows of a file when a store is created; a range is spread when it holds twice as many.
TARGET_ROWS = 1_000_000
#: Bound of the list of files that is shipped to tasks (1 GB files: 1 PB of records).
MAX_FILES = 1_000_000
FILES_SCHEMA = "path string, lo string, parts int, part int, rows long"


class StoreError(ValueError):
    pass


def commit_log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root.rstrip('/')}/log")


def _head(spark: SparkSession, root: str, version: int | None = None) -> dict:
    log = commit_log(spark, root)
    head = log.last() if version is None else log.read(version)
    if head is None:
        raise StoreError(f"{root}: no record store")
    return head


def store_files(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live files of a version (default: the last)."""
    head = _head(spark, root, version)
    return spark.read.schema(FILES_SCHEMA).parquet(f"{root.rstrip('/')}/{head['files']}")


def _ranges(files: list) -> tuple[list[str], list[int]]:
    """Lower bounds of the ranges, ascending, and their numbers of parts."""
    parts = {f.lo: f.parts for f in files}
    lows = sorted(parts, key=lambda s: s.encode())
    return lows, [parts[lo] for lo in lows]


def _place(spark: SparkSession, lows: list[str], parts: list[int], key: Column) -> tuple[Column, Column]:
    """Range and part of a key (a null key is in the first range)."""
    if len(lows) > MAX_FILES:
        raise StoreError(f"{len(lows)} ranges; the list of files holds at most {MAX_FILES}")
    shared = spark.sparkContext.broadcast(([lo.encode() for lo in lows], parts))

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        bounds = shared.value[0]
        return pa.array([max(0, bisect_right(bounds, (k or "").encode()) - 1) for k in keys.to_pylist()], pa.int32())

    @F.arrow_udf("int")
    def parts_of(ranges: pa.Array) -> pa.Array:
        return pa.array([shared.value[1][r] for r in ranges.to_pylist()], pa.int32())

    place = range_of(key)
    if max(parts) == 1:
        return place, F.lit(0)
    return place, F.pmod(F.xxhash64(key), parts_of(place)).cast("int")


def _write(spark: SparkSession, rows: DataFrame, root: str, key: str, lows: list[str], parts: list[int]) -> list[tuple]:
    """Writes rows to a new batch, a file per range and part; returns its files."""
    batch = f"data/{uuid.uuid4().hex}"
    place, part = _place(spark, lows, parts, F.col(key))
    placed = rows.withColumn("__range", place).withColumn("__part", part)
    placed = placed.repartition(F.col("__range"), F.col("__part")).sortWithinPartitions("__range", "__part", key)
    placed.write.partitionBy("__range", "__part").parquet(f"{root}/{batch}")
    written = spark.read.schema(rows.schema).option("basePath", f"{root}/{batch}").parquet(f"{root}/{batch}")
    names = written.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    at = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("int")
    found = names.select("path", "rows", at("__range").alias("r"), at("__part").alias("part")).collect()  # one row a file
    relative = lambda p: batch + "/" + p.split(f"/{batch}/", 1)[1]
    return [(relative(f.path), lows[f.r], parts[f.r], f.part, f.rows) for f in found]


def _commit_files(spark: SparkSession, root: str, rows: list[tuple]) -> str:
    name = f"files/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, FILES_SCHEMA).coalesce(1).write.parquet(f"{root}/{name}")
    return name


def create_store(df: DataFrame, root: str, key: str = "id", target_rows: int = TARGET_ROWS, history: DataFrame | None = None) -> dict:
    """Version 0 of a store: ``df`` dealt by range of ``key`` (a string column)."""
    spark, root = df.sparkSession, root.rstrip("/")
    log = commit_log(spark, root)
    if log.last() is not None:
        raise StoreError(f"{root}: holds a record store already")
    ranged = df.repartitionByRange(max(1, -(-df.count() // target_rows)), key).sortWithinPartitions(key)
    batch = f"data/{uuid.uuid4().hex}"
    ranged.write.parquet(f"{root}/{batch}")
    written = spark.read.schema(df.schema).parquet(f"{root}/{batch}")
    found = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("lo"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda f: (f.lo or "").encode())
    # The first range begins with the empty string: every key has a range.
    files = [
        (batch + "/" + f.path.split(f"/{batch}/", 1)[1], "" if i == 0 else f.lo, 1, 0, f.rows) for i, f in enumerate(found)
    ]
    files = files or [(None, "", 1, 0, 0)]
    entry = {
        "files": _commit_files(spark, root, files),
        "history": _write_history(history, root),
        "key": key,
        "schema": df.schema.json(),
        "target_rows": target_rows,
        "ranges": [],
    }
    if not log.put_if_absent(0, {"version": 0, **entry}):
        raise StoreError(f"{root}: another writer has created a record store here")
    return {"version": 0, "files": len(found)}


def _write_history(history: DataFrame | None, root: str) -> str | None:
    if history is None:
        return None
    name = f"history/{uuid.uuid4().hex}"
    history.write.parquet(f"{root}/{name}")
    return name


def _read_files(spark: SparkSession, root: str, head: dict, paths: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(head["schema"]))
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths])


def read_store(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All records of a version (default: the last); old versions stay readable."""
    root = root.rstrip("/")
    head = _head(spark, root, version)
    files = spark.read.schema(FILES_SCHEMA).parquet(f"{root}/{head['files']}").where("path is not null").select("path").collect()
    return _read_files(spark, root, head, [f.path for f in files])


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """History rows of all commits."""
    root = root.rstrip("/")
    names = [e["history"] for e in commit_log(spark, root).entries() if e["history"]]
    if not names:
        raise StoreError(f"{root}: no history")
    return spark.read.parquet(*[f"{root}/{n}" for n in names])


def lookup_store(spark: SparkSession, root: str, keys: list[str] | DataFrame) -> DataFrame:
    """The records of some keys; opens only the files of their ranges.

    A list is for a few keys; a DataFrame (a column named as the store's key) for
    any number.  Missing keys have no row.
    """
    root = root.rstrip("/")
    head = _head(spark, root)
    key = head["key"]
    files = spark.read.schema(FILES_SCHEMA).parquet(f"{root}/{head['files']}").collect()  # one row a file
    lows, parts = _ranges(files)
    asked = keys if isinstance(keys, DataFrame) else spark.createDataFrame([(k,) for k in keys], f"{key} string")
    place, part = _place(spark, lows, parts, F.col(key))
    touched = {(r.r, r.p) for r in asked.select(place.alias("r"), part.alias("p")).distinct().collect()}
    at = {lo: i for i, lo in enumerate(lows)}
    rows = _read_files(spark, root, head, [f.path for f in files if f.path and (at[f.lo], f.part) in touched])
    if isinstance(keys, DataFrame):
        return rows.join(asked.select(key).distinct(), key, "left_semi")
    return rows.where(F.col(key).isin(list(keys)))


def merge_store(
    spark: SparkSession,
    root: str,
    keys: DataFrame,
    rewrite: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]],
) -> dict:
    """Commits one change: ``rewrite(records of the touched ranges)`` returns these
    ranges' records anew (all that stay) and history rows.

    ``keys`` (a column named as the store's key) are all keys that the change may
    add, change or remove.  Returns version, touched and rewritten files.
    """
    root = root.rstrip("/")
    log = commit_log(spark, root)
    done = None
    while True:
        head = _head(spark, root)
        if done is not None:
            others = (set(log.read(v)["ranges"]) for v in range(done["base"] + 1, head["version"] + 1))
            if any(ranges & done["touched"] for ranges in others):
                done = None  # another commit has changed the same ranges: once more, on its records
        files = spark.read.schema(FILES_SCHEMA).parquet(f"{root}/{head['files']}").collect()  # one row a file
        if done is None:
            done = _rewrite(spark, root, head, files, keys, rewrite)
        kept = [tuple(f) for f in files if f.lo not in done["touched"]]
        entry = {
            "version": head["version"] + 1,
            **{k: head[k] for k in ("key", "schema", "target_rows")},
            "files": _commit_files(spark, root, kept + done["files"]),
            "history": done["history"],
            "ranges": sorted(done["touched"]),
        }
        if log.put_if_absent(entry["version"], entry):
            return {
                "version": entry["version"],
                "files": len(kept) + len(done["files"]),
                "touched_files": sum(f.path is not None for f in files if f.lo in done["touched"]),
                "written_files": sum(f[0] is not None for f in done["files"]),
            }


def _rewrite(spark: SparkSession, root: str, head: dict, files: list, keys: DataFrame, rewrite) -> dict:
    key = head["key"]
    lows, parts = _ranges(files)
    place, _ = _place(spark, lows, [1] * len(lows), F.col(key))
    asked = keys.select(place.alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()  # at most one row a range
    new_keys = {lows[r.r]: r.n for r in asked}
    touched = set(new_keys)
    old = [f for f in files if f.lo in touched]
    rows = {lo: sum(f.rows for f in old if f.lo == lo) + n for lo, n in new_keys.items()}
    # A range that may hold twice the target is spread over more files.
    target = head["target_rows"]
    parts = [max(p, -(-rows[lo] // target)) if lo in rows and rows[lo] > 2 * target else p for lo, p in zip(lows, parts, strict=True)]
    changed, history = rewrite(_read_files(spark, root, head, [f.path for f in old if f.path]))
    written = _write(spark, changed, root, key, lows, parts) if touched else []
    # An emptied range keeps its bound.
    filled = {f[1] for f in written}
    written += [(None, lo, 1, 0, 0) for lo in sorted(touched - filled)]
    return {"base": head["version"], "touched": touched, "files": written, "history": _write_history(history, root)}
