"""Best-fit packing of documents into token sequences, by vector best-fit.

An item is a vector: its tokens, one document, and its attention cost (tokens
squared).  A sequence has a capacity of each.  Items of equal length are equal
vectors, so best-fit runs over length classes: the histogram of lengths (at most
``capacity`` classes, however many documents) is packed on the driver, longest
first, into the open bins whose residual fits best under every constraint; bins
with the same contents are one group with a count.  Pieces then take the planned
places by their ordinal in their class.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .bytebpe import load, split_texts, vocabulary_path
from .common import slices, whole_text

CAPACITY = 2048
SEPARATOR = 0
#: Memory bounds of a worker: characters worked on at once, pre-tokens of each of
#: the two tables, and characters of a pre-token that is remembered.
BATCH_CHARS = 2_000_000
MEMO_SIZE = 300_000
MEMO_CHARS = 48

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


class IdTable:
    """Ids of pre-tokens as little-endian 32-bit words, remembered by a worker over
    its tasks: when ``recent`` is full it takes the place of ``older``, whose
    pre-tokens come back when they are met again."""

    def __init__(self, path: str):
        self.vocab = load(path)
        self.ids_of = self.vocab.piece_encoder()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens."""
        if len(self.recent) > MEMO_SIZE:
            self.recent, self.older = {}, self.recent
        special = self.vocab.special
        found = list(map(self.recent.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = self.older.get(word)
                if ids is None:
                    of_word = [special[word]] if word in special else self.ids_of(word.encode("utf-8"))
                    ids = struct.pack(f"<{len(of_word)}I", *of_word)
                found[i] = ids
                if len(word) <= MEMO_CHARS:
                    self.recent[word] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text of a slice: its distinct pre-tokens are looked up, and
        their ids join the texts by position."""
        vocab = self.vocab
        odd = [vocab.unstable.search(t) or (vocab.special_pattern is not None and vocab.special_pattern.search(t)) for t in texts]
        tokens, counts = split_texts([t for t, o in zip(texts, odd, strict=True) if not o], vocab.classes)
        coded = tokens.dictionary_encode()
        codes = coded.indices.to_numpy()
        lists = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        start = np.cumsum([0, *map(len, lists)]) // 4
        sizes = start[codes + 1] - start[codes]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"".join(lists), dtype="<u4")
        ids = flat[np.repeat(start[codes] - upto[:-1], sizes) + np.arange(int(upto[-1]))].tobytes()
        ends = (4 * upto[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]).tolist()
        plain = iter([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        # Texts with other characters or special strings, one by one.
        return [b"".join(self.lookup(vocab.pretokens(t)[0])) if o else next(plain) for t, o in zip(texts, odd, strict=True)]


@lru_cache(maxsize=2)
def id_table(path: str) -> IdTable:
    return IdTable(path)


def token_pieces(
    df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with the
    separator after them, cut only if longer than ``capacity``; the first piece
    takes the remainder, the others are full."""
    path = vocabulary or vocabulary_path()
    sep = np.array([SEPARATOR], dtype="<u4").tobytes()

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = id_table(path)
        for batch in batches:
            texts = batch.to_pylist()
            ends, pieces = [0], []
            for lo, hi in slices(texts, BATCH_CHARS):
                for raw in table.encode(texts[lo:hi]):
                    ids = memoryview(raw + sep)
                    n = len(ids) // 4
                    head = n % capacity or capacity
                    bounds = [0, *range(head, n + 1, capacity)]
                    pieces += [
                        (i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
                        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
                    ]
                    ends.append(len(pieces))
            columns = np.array(pieces, dtype=np.int64).reshape(-1, 4).T
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            values = pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["piece", "start", "length", "ids_crc32"]
            )
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__t"))
    return rows.select("doc_id", F.inline(cut("__t")))


def best_fit_plan(
    histogram: dict[int, int],
    capacity: int = CAPACITY,
    max_docs: int | None = None,
    max_cost: int | None = None,
    score: str = "dot",
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs ``histogram`` (length -> count).

    Returns the placements (length, first ordinal, count, first sequence,
    offset) and the number of sequences: the items of that length with ordinals
    first..first+count-1 go to consecutive sequences at that offset.

    Lengths go from the longest.  Among the groups of equal open bins with room
    in every dimension the best takes the items: ``dot`` the smallest weighted
    product of the bin's residual and the item (each in units of capacity),
    ``norm`` the smallest weighted norm of what would be left.  A group takes as
    many items per bin as fit, bin by bin; a group that is used in part splits.
    """
    max_docs = max_docs or capacity
    max_cost = max_cost or capacity * capacity
    caps = np.array([capacity, max_docs, max_cost], dtype=np.float64)
    w = np.array(weights)
    # Open groups: residual vector, bins, first sequence.
    residual = np.empty((0, 3), dtype=np.int64)
    bins = np.empty(0, dtype=np.int64)
    first_seq = np.empty(0, dtype=np.int64)
    placements: list[tuple[int, int, int, int, int]] = []
    n_seq = 0
    for length in sorted(histogram, reverse=True):
        left, ordinal = histogram[length], 0
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > caps).any():
            raise ValueError(f"an item of {length} tokens fits no empty sequence")
        while left:
            fits = np.flatnonzero((residual >= item).all(axis=1))
            if not len(fits):
                # New bins: as many as the items need when every bin is filled
                # with this length alone.
                per = int(min(capacity // length, max_docs, max_cost // (length * length)))
                add = -(-left // per)
                residual = np.vstack([residual, np.array([[capacity, max_docs, max_cost]], dtype=np.int64)])
                bins, first_seq = np.append(bins, add), np.append(first_seq, n_seq)
                n_seq += add
                fits = np.array([len(bins) - 1])
            r = residual[fits] / caps
            if score == "dot":
                s = r @ (w * (item / caps))
            else:
                s = np.sqrt(((r - item / caps) ** 2) @ w)
            g = fits[np.argmin(s)]
            take = int(min(left, bins[g]))
            offset = capacity - int(residual[g, 0])
            placements.append((length, ordinal, take, int(first_seq[g]), offset))
            if take < bins[g]:  # the untouched bins stay a group of their own
                residual = np.vstack([residual, residual[g]])
                bins, first_seq = np.append(bins, bins[g] - take), np.append(first_seq, first_seq[g] + take)
                bins[g] = take
            residual[g] -= item
            left, ordinal = left - take, ordinal + take
        open_ = residual[:, 0] > 0
        residual, bins, first_seq = residual[open_], bins[open_], first_seq[open_]
    return placements, n_seq


def _ordinals(pieces: DataFrame, rows: int) -> DataFrame:
    """``ordinal`` of each piece among those of its length, from 0.

    One length may hold a third of all pieces, so each is cut into about
    sqrt(rows) parts by a hash; pieces are numbered in their part and shifted by
    the sizes of the parts before it."""
    parts = max(1, round(rows**0.5 / 4))
    salted = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = salted.groupBy("length", "__part").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(
        Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select("length", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32"))
    return (
        salted.withColumn("__nth", nth)
        .join(sizes, ["length", "__part"])
        .withColumn("ordinal", F.col("__nth").cast("long") - 1 + F.col("__before"))
        .drop("__part", "__nth", "__before")
    )


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_docs: int | None = None,
    max_cost: int | None = None,
    vocabulary: str | None = None,
    score: str = "dot",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Without ``max_docs`` and ``max_cost`` only the tokens bind (a sequence of
    ``capacity`` tokens can hold no more documents or attention cost than the
    defaults).  Defined cases: a null or empty text is the separator alone;
    repeated rows are packed each; null ids are packed like any other; longer
    texts are encoded whole, then cut; an empty table gives no rows; other
    columns are ignored.  Pieces are written once (without their ids) to the
    shared folder, since their ordinals must not change between plan and use.
    """
    spark: SparkSession = df.sparkSession
    pieces = materialize(token_pieces(df, id_col, text_col, capacity, vocabulary), "token-pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placements, _ = best_fit_plan(lengths, capacity, max_docs, max_cost, score)
    plan = spark.createDataFrame(
        [(p[0], p[1], p[1] + p[2], p[3], p[4]) for p in placements],
        "length long, lo long, hi long, seq long, offset long",
    )
    # The plan has a few rows per length class, whatever the number of pieces.
    placed = _ordinals(pieces, sum(lengths.values())).join(
        F.broadcast(plan), ["length"]
    ).filter("ordinal >= lo and ordinal < hi")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq") + F.col("ordinal") - F.col("lo")).alias("sequence_id"),
        "offset",
    )
