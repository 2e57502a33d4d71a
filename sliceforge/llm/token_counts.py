"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are held as one ragged numpy array of symbol ids.  In
each round every sequence finds its pair of lowest rank and merges all places of
that pair, all sequences at once; sequences without a known pair are done.  The
symbols that are left are the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import Vocabulary, load, vocabulary_path
from .common import slices, whole_text

#: Memory bounds of a worker: characters worked on at once, distinct pre-tokens
#: and characters of a pre-token that is remembered.
BATCH_CHARS = 2_000_000
MEMO_SIZE = 1_000_000
MEMO_CHARS = 48


def count_symbols(words: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Tokens of each byte string under the merges of ``vocab``."""
    counts = np.zeros(len(words), dtype=np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    seq = np.flatnonzero(lengths)  # sequences still alive
    if not len(seq):
        return counts
    sym = vocab.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    size = lengths[seq]
    never = np.iinfo(np.int64).max
    while len(seq):
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        owner = np.repeat(np.arange(len(seq)), size)
        # Rank of the pair that begins at each symbol; none across sequences.
        key = np.empty(len(sym), dtype=np.int64)
        key[:-1] = sym[:-1] * vocab.size + sym[1:]
        key[start + size - 1] = -1
        at = np.minimum(np.searchsorted(vocab.pair_keys, key), len(vocab.pair_keys) - 1)
        known = vocab.pair_keys[at] == key
        rank = np.where(known, vocab.pair_rank[at], never)
        lowest = np.minimum.reduceat(rank, start)
        hit = known & (rank == lowest[owner])
        # In a run of equal symbols the hits overlap; every second one counts.
        place = np.flatnonzero(hit)
        if len(place):
            first = np.concatenate(([True], (np.diff(place) != 1) | (owner[place[1:]] != owner[place[:-1]])))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - begin) % 2 == 0]
        sym[place] = vocab.pair_id[at[place]]
        stay = np.ones(len(sym), dtype=bool)
        stay[place + 1] = False
        size = size - np.bincount(owner[place], minlength=len(seq))
        # Sequences that merged nothing are done and leave the arrays.
        done = lowest == never
        counts[seq[done]] = size[done]
        stay &= ~done[owner]
        sym = sym[stay]
        seq, size = seq[~done], size[~done]
    return counts


def _counter(path: str):
    memo: dict[str, int] = {}

    def learn(words: list[str], vocab: Vocabulary) -> None:
        for a, b in slices(words, BATCH_CHARS):
            part = words[a:b]
            memo.update(zip(part, count_symbols([w.encode("utf-8") for w in part], vocab).tolist(), strict=True))

    def count(texts: list[str]) -> list[int]:
        vocab = load(path)
        out: list[int] = []
        for a, b in slices(texts, BATCH_CHARS):
            if len(memo) > MEMO_SIZE:
                memo.clear()
            memo.update(dict.fromkeys(vocab.special, 1))
            # Texts that hold new pre-tokens wait until the batch's are counted.
            waiting: list[tuple[int, list[str]]] = []
            new: set[str] = set()
            for text in texts[a:b]:
                parts = vocab.pretokens(text)[0]
                found = list(map(memo.get, parts))
                if None in found:
                    waiting.append((len(out), parts))
                    new.update(p for p, n in zip(parts, found, strict=True) if n is None)
                    out.append(0)
                else:
                    out.append(sum(found))
            learn(list(new), vocab)
            for i, parts in waiting:
                out[i] = sum(map(memo.__getitem__, parts))
            for word in new:  # long pre-tokens are not remembered
                if len(word) > MEMO_CHARS:
                    del memo[word]
        return out

    return count


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library that belongs to the vocabulary file, no
    special tokens added, special strings inside texts one token each.  Defined
    cases: a null or empty text has 0 bytes and tokens; repeated rows and null
    ids are counted like any other; texts of any length are counted whole, one
    at a time when longer than the batch bound; an empty table gives no rows;
    other columns are ignored.  The work is narrow: no shuffle.
    """
    count = _counter(vocabulary or vocabulary_path())

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(count(texts.tolist()), dtype="int64")

    rows = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__t"))
    rows = rows.select("doc_id", F.octet_length("__t").cast("long").alias("n_bytes"), n_tokens("__t").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
