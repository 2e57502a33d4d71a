"""SentencePiece encoding and decoding by a distinct-chunk table.

If no piece holds a space marker behind another character, no merge crosses the
place where a marker follows a word, and the ids of a text are those of its
marked words in a row.  A slice of documents is held as the table of its distinct
chunks and, per document, the places of its chunks in that table.  Each chunk of
the table is segmented once, and the ids join the documents by position (ragged
arrays).  What a worker has segmented before it remembers (bounded), whatever
task comes next.  Character runs that no piece holds but as a whole (line ends,
for the given vocabulary) are chunks of their own.

The work is narrow: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import vocabulary_path
from .common import whole_text

MODEL = "piece_bpe_32k.model"
#: Memory bounds of a worker: bytes of a slice (a longer text is a slice of
#: its own), chunks and characters of a chunk that are remembered.
SLICE_BYTES = 2_000_000
MEMO_SIZE = 150_000
MEMO_CHARS = 48
#: Chunks handed to the library at once.
CALL_CHUNKS = 50
MARK = "▁"
MARK_BYTES = MARK.encode()
WALL = "\n"


class PieceModel:
    """A SentencePiece model, and whether its texts may be cut into chunks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        # The id sequence of a text that begins behind a wall is that of the wall,
        # then that of the text, without the marker that the library puts first.
        self.wall = self.library.encode(WALL)
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        walled = not any(WALL in p for p in pieces)
        self.chunked = not crossing and walled and self._keeps_characters()
        self.unknown = self.library.unk_id()
        # What each id adds to a decoded text.
        plain = [p.replace(MARK, " ").encode() for p in pieces]
        for i in range(n):
            if self.library.is_byte(i):
                plain[i] = bytes([int(pieces[i][1:-1], 16)])
            elif self.library.is_control(i):
                plain[i] = b""
        self.marked = [p.startswith(MARK) for p in pieces]
        self.plain = plain
        self.byte_start = np.concatenate(([0], np.cumsum([len(p) for p in plain]))).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(plain), dtype=np.uint8)

    def _keeps_characters(self) -> bool:
        """The normaliser puts a marker first, makes spaces markers, and changes
        nothing else (tried on every character)."""
        every = "".join(chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000)))
        probe = "  a  " + every + "  "
        return self.library.normalize(probe) == MARK + probe.replace(" ", MARK)

    def chunk_starts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the chunks of texts begin: ``data`` their bytes, one text after
        another, each behind the space put first, beginning at ``starts``."""
        if not self.chunked:
            return starts
        space = data == ord(" ")
        for at in np.flatnonzero((data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2])):
            space[at : at + 3] = True
        wall = data == ord(WALL)
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = (space[1:] & ~space[:-1]) | (wall[1:] != wall[:-1])
        begins[starts] = True
        return np.flatnonzero(begins)

    def cut(self, texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The chunks of texts, one after another, and how many each text has."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        ends = offsets - offsets[0]
        filled = np.flatnonzero(np.diff(ends))
        starts = ends[filled]
        if self.chunked:  # the library puts a marker before a text that is not empty
            data = np.insert(data, starts, ord(" "))
            starts = starts + np.arange(len(starts))
        begin = self.chunk_starts(data, starts)
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[filled] = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))
        bounds = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        return pa.LargeStringArray.from_buffers(len(begin), bounds, pa.py_buffer(np.ascontiguousarray(data))), counts

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and where each one's begin (and the
        last one's end).  A call takes some chunks with walls between them."""
        if not self.chunked:
            lists = self.library.encode(chunks)
            flat = np.array([i for ids in lists for i in ids], dtype=np.int32)
            return flat, np.cumsum([0, *map(len, lists)])
        walls = [i for i, c in enumerate(chunks) if c[0] == WALL]
        if walls:  # runs of walls are their own ids
            words = [c for c in chunks if c[0] != WALL]
            flat, start = self.segment(words)
            sizes = np.diff(start).tolist()
            parts, at, begin = [], 0, 0
            for i in walls:
                parts += [flat[start[at] : start[at + i - begin]], np.full(len(chunks[i]), self.wall[-1], dtype=np.int32)]
                sizes.insert(i, len(chunks[i]))
                at, begin = at + i - begin, i + 1
            parts.append(flat[start[at] :])
            return np.concatenate(parts), np.cumsum([0, *sizes])
        flat: list[int] = []
        for a in range(0, len(chunks), CALL_CHUNKS):
            flat += self.library.encode(WALL + WALL.join(chunks[a : a + CALL_CHUNKS]))[len(self.wall) - 1 :]
        ids = np.array(flat, dtype=np.int32)
        wall = ids == self.wall[-1]
        place = np.flatnonzero(wall)
        return ids[~wall], np.append(place - np.arange(len(place)), len(ids) - len(place))

    def text_of(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode gives it."""
        if not len(ids):
            return ""
        if not self.plain[ids[0]] or (ids == self.unknown).any():  # rules of their own for spaces
            return self.library.decode(ids.tolist())
        raw = _gather(self.bytes, self.byte_start, ids).tobytes()
        if self.marked[ids[0]]:  # the marker put first
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:  # bytes that make no character
            return self.library.decode(ids.tolist())

    def texts_of(self, lists: pa.ListArray) -> pa.StringArray:
        start = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        return pa.array([self.text_of(flat[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)], pa.string())


def _gather(values: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ragged rows ``values[start[r]:start[r + 1]]``, one after another."""
    lengths = start[rows + 1] - start[rows]
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(start[rows] - before, lengths) + np.arange(int(lengths.sum()))]


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class ChunkTable:
    """Ids of chunks, segmented once and remembered as 32-bit words.

    What was asked for lately is remembered: when ``recent`` is full it takes the
    place of ``older``, whose chunks come back when they are met again."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.recent) > MEMO_SIZE:
            self.recent, self.older = {}, self.recent
        found = list(map(self.recent.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            ids = self.older.get(chunks[i])
            if ids is None:
                new.append(i)
            else:
                found[i] = self.recent[chunks[i]] = ids
        flat, start = self.model.segment([chunks[i] for i in new])
        raw, ends = flat.tobytes(), (4 * start).tolist()
        for i, a, b in zip(new, ends[:-1], ends[1:], strict=True):
            found[i] = ids = raw[a:b]
            if len(chunks[i]) <= MEMO_CHARS:
                self.recent[chunks[i]] = ids
        return found

    def encode(self, texts: pa.LargeStringArray) -> pa.ListArray:
        """Ids of each text of a slice."""
        chunks, counts = self.model.cut(texts)
        coded = chunks.dictionary_encode()
        rows = coded.indices.to_numpy()
        lists = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        start = np.cumsum([0, *map(len, lists)]) // 4
        tokens = _gather(np.frombuffer(b"".join(lists), dtype=np.int32), start, rows)
        # Tokens up to each chunk, then up to each document's last chunk.
        upto = np.concatenate(([0], np.cumsum(start[rows + 1] - start[rows])))
        ends = upto[np.concatenate(([0], np.cumsum(counts)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))


def text_slices(texts: pa.LargeStringArray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``max_bytes`` bytes (a longer text is its own)."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + max_bytes, side="right")) - 1)
        yield a, b
        a = b


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """The table of a worker, kept over its tasks."""
    return ChunkTable(load(path))


def encode_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | None = None,
    decoded: bool = False,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, ids (array<int>, without begin or end ids)
    and, if asked for, ``decoded``, the text that :func:`decode_ids` gives of them.

    Ids are those of the library that belongs to the model file.  Defined cases: a
    null or empty text has no ids; repeated rows and null ids are encoded like any
    other; a text of any length is encoded whole (a slice of its own if it is
    longer than ``slice_bytes``); a model whose pieces cross markers, or whose
    normaliser changes characters, takes each whole text as one chunk; an empty
    table gives no rows; other columns are ignored.
    """
    path = model or vocabulary_path(MODEL)
    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            for a, b in text_slices(texts, slice_bytes):
                ids = table.encode(texts.slice(a, b - a))
                columns = {"doc_id": batch.column(0).slice(a, b - a), "ids": ids}
                if decoded:
                    columns["decoded"] = table.model.texts_of(ids)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {id_type}, ids array<int>" + (", decoded string" if decoded else ""))


def decode_ids(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """``encoded`` with the text of each list of ids, as the library decodes it:
    markers are spaces (the one put first goes), byte pieces are joined to
    characters.  Null is the empty list."""
    path = model or vocabulary_path(MODEL)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(path)
        for lists in batches:
            yield pieces.texts_of(lists)

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return encoded.withColumn(out_col, text(ids))


def encoding_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded texts."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
