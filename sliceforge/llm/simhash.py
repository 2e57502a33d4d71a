"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints with at most
four differing bits share at least four of them, so a pair is retained when its
tally of shared positional bytes reaches four, and then verified bit by bit.
The index is keyed by four positions and their bytes at once (the intersection
of four posting lists), so a list holds only pairs whose tally is reached;
lists of single bytes would hold a share of 1/32 of all pairs.

Lists that hold very many fingerprints (a large group of near copies) are
refined exactly: if the bytes outside the key are cut into five blocks of bits, a
pair with at most four differing bits agrees in at least one of them, which
becomes part of a longer key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text
from .components import component_labels

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: A list of more fingerprints is refined, until all but LAST_BITS are in its key.
LIST_SIZE = 2048
LEVELS = 3

QUADS = list(combinations(range(8), 4))
#: The first four shared positions of each set of shared positions: of the up to
#: seventy lists that a pair meets in, the one that reports it.
FIRST_QUAD = np.array(
    [
        QUADS.index(tuple([i for i in range(8) if mask >> i & 1][:4])) if bin(mask).count("1") >= 4 else -1
        for mask in range(256)
    ]
)


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all shingles (repeats count); 0 without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: n - words_per_shingle + 1].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return df.select(F.col(id_col).alias("doc_id"), fp(whole_text(text_col)).alias("fp"))


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): each distinct fingerprint in its seventy lists."""

    def key(n: int, quad: tuple[int, ...]) -> F.Column:
        k = F.lit(n).cast("long")
        for i in quad:
            byte = F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))
            k = F.shiftleft(k, 8).bitwiseOR(byte)
        return k

    keys = F.array(*[key(n, quad) for n, quad in enumerate(QUADS)])
    return fps.select("fp").distinct().select(F.explode(keys).alias("key"), "fp")


def _outside_bits(quad: int) -> list[int]:
    """Bits of a fingerprint that the key of this quad does not hold."""
    return [8 * i + b for i in range(8) if i not in QUADS[quad] for b in range(8)]


def refined(key: np.ndarray, fp: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Longer keys for the postings of long lists: at level 1 the 32 bits outside
    the quad are cut into five blocks, at level 2 the bits outside that, ...

    The key gets the block's number and bits appended; 8 bytes hold three levels.
    """
    keys, fps = [], []
    fp_bits = fp.view(np.uint64)
    # The path (quad, then block numbers) is read back from the key.
    quad, blocks, _ = _path(key, level - 1)
    for q, path in sorted(set(zip(quad.tolist(), map(tuple, blocks.tolist()), strict=True))):
        rows = np.flatnonzero((quad == q) & (blocks == np.array(path, dtype=np.int64).reshape(1, -1)).all(axis=1))
        left = _bits_left(q, path)
        for n, block in enumerate(_cut(left)):
            value = np.zeros(len(rows), dtype=np.int64)
            for bit in block:
                value = value << 1 | (fp_bits[rows] >> np.uint64(bit) & np.uint64(1)).astype(np.int64)
            width = WIDTHS[level - 1]
            keys.append((key[rows] << (3 + width)) | (n << width) | value)
            fps.append(fp[rows])
    return np.concatenate(keys), np.concatenate(fps)


#: Bits of the largest block at each level: 32, then 25, then 20 bits by five.
WIDTHS = (7, 5, 4)


def _cut(bits: list[int]) -> list[list[int]]:
    size = -(-len(bits) // 5)
    return [bits[i : i + size] for i in range(0, len(bits), size)]


def _bits_left(quad: int, path: tuple[int, ...]) -> list[int]:
    left = _outside_bits(quad)
    for n in path:
        block = _cut(left)[n]
        left = [b for b in left if b not in block]
    return left


def _path(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quad and block numbers of keys of a level."""
    blocks = []
    key = key.view(np.uint64).copy()
    for width in reversed(WIDTHS[:level]):
        blocks.append((key >> np.uint64(width) & np.uint64(7)).astype(np.int64))
        key >>= np.uint64(3 + width)
    quad = (key >> np.uint64(32)).astype(np.int64)
    return quad, np.array(blocks[::-1], dtype=np.int64).reshape(level, len(key)).T, key


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Set of equal positional bytes of pairs, as eight bits, from their xor."""
    equal = x.view(np.uint8).reshape(-1, 8) == 0
    return np.packbits(equal, axis=1, bitorder="little")[:, 0]


def pair_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links of one list's fingerprints: its components by the
    smallest member.  All pairs are compared here, in blocks; not emitted."""
    u = fp.view(np.uint64)
    left, right = [], []
    for a in range(0, len(u), 512):
        x = u[a : a + 512, None] ^ u[None, a + 1 :]
        i, j = np.nonzero(np.bitwise_count(x) <= max_bits)
        keep = j + 1 > i
        left.append(i[keep] + a)
        right.append(j[keep] + a + 1)
    i, j = np.concatenate(left), np.concatenate(right)
    tally = np.bitwise_count(shared_bytes(np.ascontiguousarray(u[i] ^ u[j])))
    i, j = i[tally >= 8 - max_bits], j[tally >= 8 - max_bits]
    label = np.arange(len(u))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(u)))
    return fp[other], fp[label[other]]


def list_links(key: np.ndarray, fp: np.ndarray, level: int, max_bits: int):
    """Links of whole lists (sorted by key), and the postings of lists that are
    too long for this level."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    a, b = [], []
    # Short lists: rows d apart in the same list, for all lists at once.
    row_size = np.repeat(size, size)
    place = np.arange(len(key)) - np.repeat(start, size)
    quad = _path(key, level)[0]
    short = row_size <= 8
    for d in range(1, 8):
        i = np.flatnonzero(short & (place + d < row_size))
        if not len(i):
            break
        x = fp[i].view(np.uint64) ^ fp[i + d].view(np.uint64)
        shared = shared_bytes(x)
        tally = np.bitwise_count(shared)
        ok = (tally >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)
        if level == 0:
            ok &= FIRST_QUAD[shared] == quad[i]
        a.append(fp[i[ok]])
        b.append(fp[i[ok] + d])
    over_key, over_fp = [], []
    for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        if n > LIST_SIZE and level < LEVELS:
            over_key.append(key[s : s + n])
            over_fp.append(fp[s : s + n])
        else:
            x, y = pair_links(fp[s : s + n], max_bits)
            a.append(x)
            b.append(y)
    none = [np.empty(0, dtype=np.int64)]
    return tuple(np.concatenate(v or none) for v in (a, b, over_key, over_fp))


LINK_SCHEMA = "over boolean, a long, b long"


def _scan(level: int, max_bits: int):
    """mapInArrow over postings sorted by key: (false, a, b) for links,
    (true, key, fp) for the refined postings of long lists."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(over: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch(
                {"over": pa.array(np.full(len(a), over)), "a": pa.array(a), "b": pa.array(b)}
            )

        key = fp = np.empty(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False)))
            if len(key) < 1 << 17:
                continue
            # The last list may go on in the next batch.
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield from emit(out, key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield from emit(out, key, fp)

    def emit(out, key, fp):
        a, b, over_key, over_fp = list_links(key, fp, level, max_bits)
        if len(a):
            yield out(False, a, b)
        if len(over_key):
            for at in range(0, len(over_key), 1 << 16):
                yield out(True, *refined(over_key[at : at + (1 << 16)], over_fp[at : at + (1 << 16)], level + 1))

    return scan


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of ``fps`` that can be
    reached by steps of at most ``max_bits`` differing bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("four shared bytes are guaranteed for up to 4 differing bits")
    todo, links = postings(fps), None
    for level in range(LEVELS + 1):
        lists = todo.repartition("key").sortWithinPartitions("key")
        found = materialize(lists.mapInArrow(_scan(level, max_bits), LINK_SCHEMA), "fingerprint-links")
        part = found.filter("not over").select("a", "b")
        links = part if links is None else links.union(part)
        todo = found.filter("over").select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct()
        if level == LEVELS or found.filter("over").isEmpty():
            break
    return links.distinct()


def simhash_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id that can be reached over links.  Defined
    cases: a null text is empty, and texts without words have fingerprint zero
    and link like any other; with fewer words than a shingle the whole sequence
    is the shingle; equal texts, repeated rows and ties share a component; null
    ids are members but never name a component that has another id; texts of any
    length are read whole; an empty table gives no rows; other columns are ignored.
    """
    fps = materialize(fingerprints(df, id_col, text_col, words_per_shingle), "fingerprints")
    labels = component_labels(fingerprint_links(fps, max_bits)).select(F.col("node").alias("fp"), "root")
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(labels, "fp", "left")
    each = each.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    roots = each.groupBy("root").agg(F.min("low").alias("component_id"))
    named = each.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each group, the one of the smallest id: all its
    columns.  Rows that repeat an id are one document; those without an id stay."""
    groups = simhash_groups(df, id_col, text_col, **options)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
