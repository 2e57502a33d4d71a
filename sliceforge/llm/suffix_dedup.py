"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier in
the corpus.  Positions get ranks (names of equal substrings) by prefix doubling,
Spark sorts position-rank pairs, positions whose rank is unique drop out, and
the others are ranked again at growing lengths until they are unique or the
length passes the threshold.

Only sampled positions are sorted: of the 16-byte substrings in a LENGTH window
the smallest one (by rank, then leftmost) is the window's anchor.  Equal windows
have equal anchors at equal places, and an anchor stands for the run of windows
that chose it, about one position in forty.

* Length 16: anchors of unique rank decide all their windows (none repeats).
* Length 184, the union of all windows around an anchor: of the anchors with
  equal unions, all but the first repeat with all their windows.
* Length 58, which all windows on one side of the anchor contain: unique again
  decides the windows of that side.
* Length LENGTH: the windows that are left are compared one by one, in the group
  of their anchor's rank.

A rank that takes a great share of all positions (a passage in a third of the
documents) would bring its positions together in one task.  Such ranks are found
on a sample; their anchors are grouped by the union and their windows by their
own rank instead.  This changes where rows meet, not what is removed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import release, whole_text
from .ranks import pair, window_ranks

LENGTH = 100
GRAM = 16
#: Grams in a window; reach of the union to the left of the anchor.
GRAMS = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
HALF = REACH // 2
SIDE = LENGTH - HALF
PAD = LENGTH
#: Bytes worked on at once, and the longest piece of one document.
CHUNK_BYTES = 1 << 19
PIECE_BYTES = 1 << 22
#: Bytes of text whose decisions are held at once (one longer text is held alone).
SLICE_BYTES = 1 << 21
#: Share of the sampled anchors that makes a rank hot, and the sample (1 of n documents).
HOT_SHARE = 1 / 20_000
HOT_SAMPLE = 64
COVERED, RIGHT, LEFT = 1, 2, 4

SYMBOLS = np.random.default_rng(20).integers(1, 2**63, 257, dtype=np.uint64) | np.uint64(1)
LOW = np.uint64(0xFFFFFF)


def ranks_at(grams: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the windows of ``length`` at places ``at``, from the ranks of GRAM
    bytes at every place, by doubling."""
    if length == GRAM:
        return grams[at]
    h = GRAM
    while 2 * h < length:
        h *= 2
    return pair(ranks_at(grams, at, h), ranks_at(grams, at + (length - h), h)) ^ np.uint64(length)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    h = 1
    while 2 * h <= width:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (width - h)], x[width - h :]) if h < width else x


class Chunk:
    """Documents laid out in one array, with gaps that no window crosses."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]]):
        # pieces: (document number in the batch, first window of the piece, odd piece, bytes)
        size = [len(b) for *_, b in pieces]
        self.owner = np.array([d for d, *_ in pieces])
        self.shift = np.array([s for _, s, _, _ in pieces], dtype=np.int64)
        #: 0 or 1 in turn: an anchor near a cut is in both pieces, with other windows.
        self.odd = np.array([o for _, _, o, _ in pieces], dtype=np.int64)
        self.base = np.concatenate(([0], np.cumsum(np.array(size) + PAD)[:-1])).astype(np.int64) + PAD
        gap = np.full(PAD, 256, dtype=np.uint16)
        parts: list[np.ndarray] = [gap]
        for *_, b in pieces:
            parts += [np.frombuffer(b, dtype=np.uint8).astype(np.uint16), gap]
        symbols = np.concatenate([*parts, gap])
        self.grams = window_ranks(SYMBOLS[symbols], GRAM)
        order = (self.grams & ~LOW) | np.arange(len(self.grams), dtype=np.uint64)
        lowest = (sliding_min(order, GRAMS) & LOW).astype(np.int64)
        windows = np.concatenate([np.arange(a, a + n - LENGTH + 1) for a, n in zip(self.base.tolist(), size, strict=True)])
        chosen = lowest[windows]
        new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1))))
        last = np.append(new[1:], len(windows)) - 1
        #: Anchors, and the first and last window of each.
        self.anchor, self.first, self.last = chosen[new], windows[new], windows[last]
        self.piece = np.searchsorted(self.base, self.first, side="right") - 1

    def place(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Place in the document."""
        return at - self.base[piece] + self.shift[piece]


def chunks(texts: Iterable[bytes], piece_bytes: int | None = None) -> Iterator[Chunk]:
    """Chunks of a batch; texts below LENGTH have no window.  A document longer
    than a piece (PIECE_BYTES) is cut so that each window is in one piece."""
    piece_bytes = piece_bytes or PIECE_BYTES
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for d, b in enumerate(texts):
        for s in range(0, len(b) - LENGTH + 1, piece_bytes):
            piece = b[s : s + piece_bytes + LENGTH - 1]
            held.append((d, s, s // piece_bytes & 1, piece))
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield Chunk(held)
                held, size = [], 0
    if held:
        yield Chunk(held)


def text_slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of the texts in column ``text``."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def list_rows(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and the row of each (null lists have none)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), size)


def lists_of(row: np.ndarray, n: int, values: dict[str, pa.Array]) -> pa.ListArray:
    """One list of structs for each of ``n`` rows; ``row`` is the row of each value, ascending."""
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(values.values()), names=list(values)))


def first_of_group(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray):
    """Rows ordered by ``keys``, doc and pos: (order, starts a group, is after the
    group's first position)."""
    order = np.lexsort((pos, doc, *keys[::-1]))
    sorted_keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, p = doc[order], pos[order]
    return order, new, (d != d[start]) | (p != p[start])


def several(group: np.ndarray, new_context: np.ndarray) -> np.ndarray:
    """Rows whose group has two or more contexts; ``new_context`` marks one row
    of each context."""
    _, inverse = np.unique(group, return_inverse=True)
    return np.bincount(inverse, new_context)[inverse] >= 2


def _positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, t): the id (null: the smallest long), 24 bits of the text's hash
    that tell rows of one id apart, and the text as bytes."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return df.select(doc.alias("doc"), whole_text(text_col).alias("s")).select(
        "doc", F.xxhash64("s").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("mark"), F.col("s").cast("binary").alias("t")
    )


def hot_ranks(rows: DataFrame) -> np.ndarray:
    """Ranks of more than HOT_SHARE of the anchors of a sample (so at most
    1 / HOT_SHARE of them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [c.grams[c.anchor] for c in chunks(x.as_py() for x in b.column(0))]
            if found:
                rank, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"rank": pa.array(rank.view(np.int64)), "n": pa.array(n)})

    sample = rows.filter(F.pmod(F.xxhash64("doc", "mark"), F.lit(HOT_SAMPLE)) == 0).select("t")
    counts = sample.mapInArrow(count, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
    counts = materialize(counts.filter("n >= 8"), "rank-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(8, total * HOT_SHARE)).select("rank").collect()
    return np.sort(np.array([r["rank"] for r in hot], dtype=np.int64))


ANCHOR_ROWS = "rank long, context long, sides long, doc long, pos long, odd long, state int"


def anchor_rows(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Position-rank rows of all anchors.  ``pos`` is the place (upper bits) and
    the mark, ``odd`` tells the two pieces of a cut apart; ``state`` 1: covered by
    an earlier anchor of the batch, 2: hot."""
    piece_bytes = PIECE_BYTES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in chunks((x.as_py() for x in b.column(2)), piece_bytes):
                at, owner = c.anchor, c.owner[c.piece]
                rank = c.grams[at].view(np.int64)
                context = ranks_at(c.grams, at - REACH, LENGTH + REACH).view(np.int64)
                right = ranks_at(c.grams, at, SIDE) >> np.uint64(32)
                left = ranks_at(c.grams, at - HALF, SIDE) >> np.uint64(32)
                sides = (right << np.uint64(32) | left).view(np.int64)
                doc, pos = ids[owner], c.place(at, c.piece) << 24 | marks[owner]
                order, _, later = first_of_group([rank, context], doc, pos)
                state = np.zeros(len(at), dtype=np.int32)
                state[order[later]] = 1
                is_hot = np.isin(rank, hot)
                state[is_hot & (state == 0)] = 2
                # Hot ranks meet by context; what is decided meets nobody.
                rank = np.where(is_hot, rank ^ context, rank)
                rank = np.where(state == 1, pair(doc.view(np.uint64), pos.view(np.uint64)).view(np.int64), rank)
                columns = (rank, context, sides, doc, pos, c.odd[c.piece], state)
                names = ["rank", "context", "sides", "doc", "pos", "odd", "state"]
                yield pa.record_batch([pa.array(v) for v in columns], names=names)

    return rows.select("doc", "mark", "t").mapInArrow(scan, ANCHOR_ROWS)


def _runs(batches: Iterator[pa.RecordBatch], size: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches sorted by their first column, put together so that equal values
    stay together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < size:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def decided_anchors(anchors: DataFrame) -> DataFrame:
    """(doc, pos, odd, flags) of anchors whose windows repeat or may repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            rank, context, sides, doc, pos, odd, state = (t.column(i).to_numpy() for i in range(7))
            order, new, later = first_of_group([rank, context], doc, pos)
            rank, sides, doc, pos = rank[order], sides[order].view(np.uint64), doc[order], pos[order]
            odd, state = odd[order], state[order]
            flags = np.where(later | (state == 1), COVERED, 0)
            rep = flags == 0
            # One row of each context counts; rows at the same position follow it.
            r, one = rank.view(np.uint64)[rep], new[rep]
            flags[rep] = np.where(several(pair(r, sides[rep] >> np.uint64(32)), one), RIGHT, 0) + np.where(
                several(pair(r, sides[rep] & np.uint64(0xFFFFFFFF)), one), LEFT, 0
            )
            flags[rep & (state == 2)] = RIGHT + LEFT
            some = flags > 0
            columns = (doc[some], pos[some], odd[some], flags[some])
            yield pa.record_batch([pa.array(v) for v in columns], names=["doc", "pos", "odd", "flags"])

    return anchors.repartition("rank").sortWithinPartitions("rank").mapInArrow(scan, "doc long, pos long, odd long, flags long")


def _by_document(flagged: DataFrame, value: F.Column, name: str) -> DataFrame:
    """Lists per document (bounded by the document)."""
    return flagged.groupBy("doc", F.col("pos").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("mark")).agg(
        F.collect_list(value).alias(name)
    )


WINDOW_ROWS = (
    "doc long, mark long, covered array<struct<a:long,b:long>>, windows array<struct<key:long,first:long,ranks:binary>>"
)


def open_windows(rows: DataFrame, flagged: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc, mark, covered, windows) of the documents with flagged anchors: runs of
    windows that repeat, and runs that are to be compared, with their ranks."""
    piece_bytes = PIECE_BYTES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                yield pa.record_batch([part.column(0), part.column(1), *_open(part, hot, piece_bytes)], names=names)

    names = ["doc", "mark", "covered", "windows"]
    packed = F.shiftleft(F.shiftright("pos", 24), 4) + F.shiftleft("odd", 3) + F.col("flags")
    lists = _by_document(flagged, packed, "flagged")
    joined = rows.join(lists, ["doc", "mark"])
    return joined.select("doc", "mark", "t", "flagged").mapInArrow(scan, WINDOW_ROWS)


def _open(part: pa.RecordBatch, hot: np.ndarray, piece_bytes: int) -> tuple[pa.ListArray, pa.ListArray]:
    """The lists ``covered`` and ``windows`` of a slice of documents with their flags."""
    none = np.zeros(0, dtype=np.int64)
    # Of the runs in order of document: document, first and last window; of the
    # windows: document, key, first window, and their ranks with the number of them.
    covered: list[tuple[int, int, int]] = []
    owners, keys, firsts, counts, values = [none], [none], [none], [none], [none.view(np.uint64)]
    found, row = list_rows(part.column(3))
    flags = np.split(found.to_numpy(zero_copy_only=False), np.searchsorted(row, np.arange(1, part.num_rows)))
    flags = [np.unique(f) for f in flags]
    for c in chunks((x.as_py() for x in part.column(2)), piece_bytes):
        owner = c.owner[c.piece]
        # Flag of each anchor: its packed place is looked up in its document's list.
        place = c.place(c.anchor, c.piece)
        known = place << 1 | c.odd[c.piece]
        flag = np.zeros(len(place), dtype=np.int64)
        for d in np.unique(owner).tolist():
            at = np.flatnonzero(owner == d) if len(c.owner) > 1 else np.arange(len(place))
            i = np.minimum(np.searchsorted(flags[d] >> 3, known[at]), len(flags[d]) - 1)
            flag[at] = np.where(flags[d][i] >> 3 == known[at], flags[d][i] & 7, 0)
        shift = place - c.anchor
        rank = c.grams[c.anchor].view(np.int64)
        is_hot = np.isin(rank, hot)
        for i in np.flatnonzero(flag).tolist():
            d, a, b = int(owner[i]), int(c.first[i]), int(c.last[i])
            s, f, middle = int(shift[i]), int(flag[i]), int(c.anchor[i]) - HALF
            if f & COVERED:
                covered.append((d, a + s, b + s))
                continue
            if not f & RIGHT:
                b = min(b, middle - 1)
            if not f & LEFT:
                a = max(a, middle)
            if a > b:
                continue
            windows = np.arange(a, b + 1)
            values.append(ranks_at(c.grams, windows, LENGTH))
            # A run goes by the rank of its anchor, windows of hot ranks by their own.
            m = len(windows) if is_hot[i] else 1
            owners.append(np.full(m, d))
            keys.append(values[-1].view(np.int64) if is_hot[i] else rank[i : i + 1])
            firsts.append(windows[:m] + s)
            counts.append(np.full(m, len(windows) // m))
    runs = np.array(covered, dtype=np.int64).reshape(-1, 3)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(counts) * 8))).astype(np.int32)
    ranks = pa.py_buffer(np.concatenate(values))
    return (
        lists_of(runs[:, 0], part.num_rows, {"a": pa.array(runs[:, 1].copy()), "b": pa.array(runs[:, 2].copy())}),
        lists_of(
            np.concatenate(owners),
            part.num_rows,
            {
                "key": pa.array(np.concatenate(keys)),
                "first": pa.array(np.concatenate(firsts)),
                "ranks": pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), ranks]),
            },
        ),
    )


def repeated_windows(opened: DataFrame) -> DataFrame:
    """(doc, pos) of the open windows that also start earlier."""
    windows = opened.select("doc", "mark", F.explode("windows").alias("w")).select(
        "w.key", "doc", F.shiftleft("w.first", 24).bitwiseOR(F.col("mark")).alias("pos"), "w.ranks"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 1 << 14):
            ranks = t.column(3).to_pylist()
            n = np.fromiter(map(len, ranks), dtype=np.int64, count=len(ranks)) // 8
            rank = np.frombuffer(b"".join(ranks), dtype=np.int64)
            step = np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n)
            key, doc = np.repeat(t.column(0).to_numpy(), n), np.repeat(t.column(1).to_numpy(), n)
            pos = np.repeat(t.column(2).to_numpy(), n) + (step << 24)
            order, _, later = first_of_group([key, rank], doc, pos)
            found = order[later]
            yield pa.record_batch([pa.array(doc[found]), pa.array(pos[found])], names=["doc", "pos"])

    sorted_ = windows.repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(scan, "doc long, pos long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed runs, array of start
    and end in bytes), kept (the remaining bytes).

    Earlier means a smaller id, or the same id and a smaller start.  Matches do
    not cross documents, and strings are judged on the input.  Defined cases: a
    null text is empty; texts under LENGTH bytes lose nothing; ids that are null
    come before all others; rows that repeat id and text are one document, which
    does not repeat itself by that (both rows give the same result); rows of one
    id with different texts are told apart by a hash of the text, which also
    orders equal starts; texts of any length are read whole; an empty table gives
    no rows; other columns are ignored.
    """
    rows = _positions(df, id_col, text_col)
    hot = hot_ranks(rows)
    flagged = materialize(decided_anchors(anchor_rows(rows, hot)), "flagged-anchors")
    release(df.sparkSession)
    opened = materialize(open_windows(rows, flagged, hot), "open-windows")
    release(df.sparkSession)
    starts = _by_document(repeated_windows(opened), F.shiftright("pos", 24), "starts").withColumnRenamed("mark", "m2")
    starts = starts.toDF("d2", "m2", "starts")
    decided = opened.select("doc", "mark", "covered").dropDuplicates(["doc", "mark"])
    decided = decided.join(starts, (F.col("doc") == F.col("d2")) & (F.col("mark") == F.col("m2")), "left")
    decided = decided.select("doc", "mark", "covered", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                yield pa.record_batch([part.column(0), part.column(1), *_cut(part)], names=names)

    names = ["doc_id", "n_bytes", "spans", "kept"]
    out = rows.withColumn("raw_id", F.when(F.col("doc") > -(2**63), F.col("doc")))
    out = out.join(decided, ["doc", "mark"], "left")
    out = out.select("raw_id", F.octet_length("t").cast("long").alias("n_bytes"), "t", "covered", "starts")
    return out.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _cut(part: pa.RecordBatch) -> tuple[pa.ListArray, pa.Array]:
    """The removed runs and the remaining bytes of a slice of documents with their
    runs of windows (a to b) and single windows that repeat."""
    texts = part.column(2).to_pylist()
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.cumsum(size) - size
    # Places in the texts one after another, with a gap so that no runs touch across documents.
    gap = base + np.arange(len(texts))
    runs, run_row = list_rows(part.column(3))
    single, row = list_rows(part.column(4))
    single = single.to_numpy(zero_copy_only=False) + gap[row]
    a, b = (runs.field(x).to_numpy(zero_copy_only=False) + gap[run_row] for x in range(2))
    start, end = _merged(np.concatenate((a, single)), np.concatenate((b, single)) + LENGTH)
    row = np.searchsorted(gap, start, side="right") - 1
    step = np.zeros(int(size.sum()) + 1, dtype=np.int8)
    # Runs of two documents may meet here, so steps are added.
    np.add.at(step, start - row, -1)
    np.add.at(step, end - row, 1)
    stays = np.cumsum(step[:-1], dtype=np.int8) == 0
    kept = np.frombuffer(b"".join(texts), dtype=np.uint8)[stays]
    n = np.concatenate(([0], np.cumsum(stays)))
    ends = np.append(n[base], n[-1]).astype(np.int32)
    spans = {"start": pa.array(start - gap[row]), "end": pa.array(end - gap[row])}
    return (
        lists_of(row, len(texts), spans),
        pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(kept)]),
    )


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes (touching runs are one)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(start)), dtype=bool), start[1:] > end[:-1])))
    return start[new], end[np.append(new[1:], len(start)) - 1] if len(start) else end


def removal_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
