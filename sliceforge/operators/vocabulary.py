"""Integer vocabularies of the rule tokenizer (C5, C6): dense ids that stay.

A vocabulary is a folder of segments, one per extension: ``(token, id)`` rows
sorted by token.  Ids are 0..n-1 without gaps; tokens that a later extension adds
get the next ids, so what was encoded before stays right.  Within an extension ids
follow the tokens' order (UTF-8 bytewise), so they do not depend on partitions.

    <root>/log/<n>.json          commits (see ``sinks.commit_log``): segments and size
    <root>/segments/<name>/      (token, id) rows of one extension
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from sliceforge.functions.tokens import regex_tokens
from sliceforge.session import materialize
from sliceforge.sinks.commit_log import CommitLog

VOCABULARY_SCHEMA = "token string, id long"
#: A value is hot if it has over one in so many of the pairs that are looked up:
#: there are fewer hot values than this, whatever the data.
HOT_SHARE = 50_000
#: Values and distinct values of a slice of rows, whose distinct values are looked up
#: together, and values of a piece of it (a row with more is a slice, or piece, alone).
SLICE_TOKENS, SLICE_VALUES, PIECE_VALUES = 1 << 22, 1 << 18, 1 << 16
#: Id of a token that is not in the vocabulary, and text of an id that is not.
UNKNOWN_ID = -1
UNKNOWN_TOKEN = "�"


def _log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root.rstrip('/')}/log")


def number_tokens(tokens: DataFrame, first: int = 0) -> DataFrame:
    """``(token, id)`` of distinct tokens: ``first`` and on, in the tokens' order.

    A range sort gives each partition its tokens in order; a token's id is its
    place there plus the tokens of the partitions before.  No task sees all tokens:
    the running total is over one row per partition.
    """
    ordered = tokens.select("token").repartitionByRange("token").sortWithinPartitions("token")
    placed = materialize(ordered.select("token", F.monotonically_increasing_id().alias("__place")), "numbering")
    # The function's documented layout: partition above bit 33, row in it below.
    part, row = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select("token", part.alias("__part"), row.alias("__row"))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select(
        "__part", F.expr(f"coalesce(sum(__n) over (order by __part rows between unbounded preceding and 1 preceding), 0) + {int(first)}").alias("__start")
    )
    return placed.join(starts, "__part").select("token", (F.col("__start") + F.col("__row")).cast("long").alias("id"))


def distinct_tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct rule tokens of a column of texts (a null text has none)."""
    return texts.select(F.explode(regex_tokens(F.col(text_col))).alias("token")).distinct()


def extend_vocabulary(texts: DataFrame, root: str, text_col: str = "text") -> dict:
    """Adds the tokens of ``texts`` that the vocabulary in ``root`` does not have;
    a folder without one gets version 0.

    Returns version, size and added.  Texts without new tokens add no version.
    Extensions may run at the same time: one that finds another's commit before its
    own numbers what is still new behind it.
    """
    spark, root = texts.sparkSession, root.rstrip("/")
    tokens = materialize(distinct_tokens(texts, text_col), "tokens")

    def extension(last: dict | None) -> dict | None:
        size = last["size"] if last else 0
        new = tokens.join(_segments(spark, root, last), "token", "left_anti") if last else tokens
        name = f"segments/{uuid.uuid4().hex}"
        number_tokens(new, size).sortWithinPartitions("token").write.parquet(f"{root}/{name}")
        added = spark.read.schema(VOCABULARY_SCHEMA).parquet(f"{root}/{name}").count()
        if last and not added:
            return None
        return {"segments": [*(last["segments"] if last else []), name], "size": size + added, "added": added}

    log = _log(spark, root)
    entry = log.append(extension)
    if entry is None:
        last = log.last()
        return {"version": last["version"], "size": last["size"], "added": 0}
    return {k: entry[k] for k in ("version", "size", "added")}


def _segments(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    return spark.read.schema(VOCABULARY_SCHEMA).parquet(*[f"{root}/{name}" for name in entry["segments"]])


def read_vocabulary(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``(token, id)`` of a version (default: the last)."""
    root, log = root.rstrip("/"), _log(spark, root)
    entry = log.last() if version is None else log.read(version)
    if entry is None:
        raise ValueError(f"{root}: no vocabulary")
    return _segments(spark, root, entry)


def _slicer(array_col: str, columns: list[str], kind: pa.DataType):
    """Rows as slices, one row each: the rows as an Arrow stream in which an array is a
    list of places in the slice's distinct values, and these values."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row counts as one more than its values, so that empty ones fill pieces too.
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(array_col)), 0).to_numpy() + 1, dtype=np.int64)
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + PIECE_VALUES, "right")))
                yield batch.slice(start, end - start)
                start = end
            del batch  # before the next one is read

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 33
        values, n = pa.array([], kind), 0
        sink = stream = None  # pieces are written as they come: a slice of one would keep its whole batch

        def whole() -> pa.RecordBatch:
            stream.close()
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            rows = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), rows, lists], ["slice", "rows", "values"])

        for piece in pieces(batches):
            arrays = piece.column(array_col)
            coded = arrays.flatten().dictionary_encode()
            known = pc.index_in(coded.dictionary, values)
            new = coded.dictionary.filter(pc.is_null(known))
            if stream and (n + len(arrays) + len(coded) > SLICE_TOKENS or len(values) + len(new) > SLICE_VALUES):
                yield whole()
                name, stream, values, n = name + 1, None, pa.array([], kind), 0
                known, new = pa.nulls(len(coded.dictionary), pa.int32()), coded.dictionary
            place = known.to_numpy(zero_copy_only=False).astype(np.float64)  # a new value's is NaN
            place[np.isnan(place)] = np.arange(len(values), len(values) + len(new))
            values = pa.concat_arrays([values, new])
            places = pa.array(place.astype(np.int32)).take(coded.indices)
            ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(arrays), 0).to_numpy()], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), places, mask=arrays.is_null())
            coded_piece = pa.RecordBatch.from_arrays([lists if c == array_col else piece.column(c) for c in columns], columns)
            if not stream:
                sink = pa.BufferOutputStream()
                stream = pa.ipc.new_stream(sink, coded_piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            stream.write_batch(coded_piece)
            n += len(arrays) + len(coded)
            del piece, arrays, coded, coded_piece
        if stream:
            yield whole()

    return slices


def _placer(array_col: str, columns: list[str], hot: dict, source: pa.DataType, target: pa.DataType, unknown, spark: SparkSession):
    """The rows of slices again, each place as the target of its value: one of the
    ``hot`` or of the slice's own ``found``."""
    shared = spark.sparkContext.broadcast((list(hot), list(hot.values())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, targets = (pa.array(x, t) for x, t in zip(shared.value, (source, target), strict=True))
        for batch in batches:
            for rows, n, values, found in zip(*(batch.column(c) for c in ("rows", "n", "values", "found")), strict=True):
                at, own = np.full(n.as_py(), np.nan), targets
                if len(common):
                    at[:] = pc.index_in(values.values, common).to_numpy(zero_copy_only=False)
                if found.values is not None:
                    own = pa.concat_arrays([targets, found.values.field("target").cast(target)])
                    at[found.values.field("at").to_numpy()] = np.arange(len(targets), len(own))
                of_value = own.take(pa.array(at, from_pandas=True).cast(pa.int32()))
                with pa.ipc.open_stream(rows.as_buffer()) as stream:
                    for piece in stream:
                        places = piece.column(array_col)
                        taken = of_value.take(places.flatten())
                        if unknown is not None:
                            taken = pc.fill_null(taken, pa.scalar(unknown, target))
                        arrays = pa.ListArray.from_arrays(places.offsets, taken, mask=places.is_null())
                        yield pa.RecordBatch.from_arrays([arrays if c == array_col else piece.column(c) for c in columns], columns)

    return place


def translate(rows: DataFrame, array_col: str, table: DataFrame, source: str, target: str, unknown, narrow=None) -> DataFrame:
    """Each value of an array column looked up in ``table`` (``source`` -> ``target``).

    Rows are stored in slices, in which an array is a list of places in the slice's
    distinct values (at most ``SLICE_VALUES``, of ``SLICE_TOKENS``, unless one row has
    more), so only the (slice, distinct value) pairs travel to the table, and their
    targets back to the slice.  Values that over one in ``HOT_SHARE`` of all pairs have
    are looked up where their slice is (fewer than ``HOT_SHARE`` values, by their
    share): no key holds more than that share of the pairs.  A value that the table
    lacks, or a null, gives ``unknown``; a null array stays null.  ``rows`` is read
    once.  With ``narrow``, a column function that keeps values apart, ``source`` is
    compared with its result, which travels in the value's place.
    """
    spark, kind = rows.sparkSession, rows.schema[array_col].dataType.elementType
    sliced = StructType([StructField("slice", LongType()), StructField("rows", BinaryType()), StructField("values", ArrayType(kind))])
    cut = rows.mapInArrow(_slicer(array_col, rows.columns, to_arrow_type(kind)), sliced)
    slices = materialize(cut.withColumn("values", F.transform("values", narrow)) if narrow else cut, "slices")
    values = slices.select("slice", F.posexplode("values").alias("at", "__value"))
    pairs = table.select(F.col(source).alias("__value"), F.col(target).alias("target"))
    many, total = slices.agg(F.count("*"), F.coalesce(F.sum(F.size("values")), F.lit(0))).first()
    cold, hot = values, {}
    if many * HOT_SHARE > total:  # else no value can be hot: a slice has it once
        often = values.groupBy("__value").agg(F.count("*").alias("__n")).where(F.col("__n") * HOT_SHARE > total).select("__value")
        hot = {r["__value"]: None for r in often.collect()}
        known = F.broadcast(spark.createDataFrame([(v,) for v in hot], often.schema))
        hot |= {r["__value"]: r["target"] for r in pairs.join(known, "__value", "left_semi").collect()}
        cold = values.join(known, "__value", "left_anti")
    found = cold.join(pairs, "__value")
    lists = found.groupBy("slice").agg(F.collect_list(F.struct("at", "target")).alias("found"))
    size = F.size("values").alias("n")
    asked = slices.select("slice", "rows", size, (F.col("values") if hot else F.lit(None).cast(slices.schema["values"].dataType)).alias("values"))
    goal, narrowed = table.schema[target].dataType, slices.schema["values"].dataType.elementType
    place = _placer(array_col, rows.columns, hot, to_arrow_type(narrowed), to_arrow_type(goal), unknown, spark)
    out = StructType([StructField(f.name, ArrayType(goal) if f.name == array_col else f.dataType) for f in rows.schema])
    return asked.join(lists, "slice", "left").select("rows", "n", "values", "found").mapInArrow(place, out)


def encode_texts(texts: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, ids)``, ``ids`` an ``array<long>`` of the rule tokens in order;
    a token that the vocabulary lacks is -1, a null text has null ids."""
    tokens = texts.select(key, regex_tokens(F.col(text_col)).alias("ids"))
    return translate(tokens, "ids", vocabulary, "token", "id", UNKNOWN_ID)


def decode_texts(encoded: DataFrame, vocabulary: DataFrame, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(key, decoded)``, the tokens of the ids joined by a space; an id that
    the vocabulary lacks is U+FFFD, null ids give a null text."""
    tokens = translate(encoded.select(key, ids_col), ids_col, vocabulary, "id", "token", UNKNOWN_TOKEN)
    return tokens.select(key, F.array_join(ids_col, " ").alias("decoded"))
