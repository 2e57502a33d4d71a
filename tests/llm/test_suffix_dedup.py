import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sliceforge.llm import suffix_dedup
from sliceforge.llm.suffix_dedup import LENGTH, removal_digests, remove_repeats

from .conftest import edge_rows


def brute(rows):
    """Rows with distinct ids, in order of id."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            w = b[p : p + LENGTH]
            if w in seen:
                gone[p : p + LENGTH] = b"\x01" * LENGTH
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rnd.randint(15, 120))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a, b = sorted(rnd.sample(range(len(p)), 2))
            parts += [p[a:b] if rnd.random() < 0.5 else p, word()]
        rows.append((i * 3, " ".join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(20)]  # exact copies
    rows += [(2000 + i, passages[0] + word()) for i in range(40)]  # a hot passage
    rows += [(3000, "a" * 1500), (3001, "ab" * 700 + "a" * 300), (3002, ""), (3003, None), (3004, "x" * 99)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, monkeypatch, hot):
    if hot:  # every rank of a few anchors takes the path of hot ranks
        monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 1e-9)
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if hot:
        assert len(suffix_dedup.hot_ranks(suffix_dedup._positions(df, "doc_id", "text"))) > 10
    got = {r["doc_id"]: tuple(r)[1:] for r in removal_digests(remove_repeats(df)).collect()}
    want = brute(rows)
    assert sum(v[1] for v in want.values()) > 10_000
    assert got == want


def test_edge_rows(edge_docs):
    rows = removal_digests(remove_repeats(edge_docs)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, *_ in edge_rows())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    # One row per id from here on: those are plain brute force.
    single = [(i, t) for i, t, *_ in edge_rows() if i not in (9, 10, None)]
    want = brute(single)
    for i, _ in single:
        assert tuple(by_id[i][0])[1:] == want[i], i
    assert len({tuple(r) for r in by_id[10]}) == 1 and by_id[10][0]["n_removed"] == 0  # a repeated row is no copy of itself


def test_long_document_in_pieces(monkeypatch):
    text = ("".join(random.Random(2).choice("abc") for _ in range(5000)) * 2).encode()
    whole = next(iter(suffix_dedup.chunks([text])))
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1500)

    def owned(chunk):
        place = chunk.place(chunk.anchor, chunk.piece)
        shift = place - chunk.anchor
        return {(int(w + s), int(p)) for a, b, s, p in zip(chunk.first, chunk.last, shift, place, strict=True) for w in range(a, b + 1)}

    assert set().union(*map(owned, suffix_dedup.chunks([text]))) == owned(whole)
    assert len(owned(whole)) == len(text) - LENGTH + 1


def test_passages_at_cuts_of_a_long_document(spark):
    n = suffix_dedup.PIECE_BYTES
    rng = np.random.default_rng(5)
    letters = lambda size, first, last: rng.integers(ord(first), ord(last) + 1, size, dtype=np.uint8).tobytes()
    passages = [letters(300, "a", "z") for _ in range(6)]
    text = bytearray(letters(6 * n + 5000, "A", "Z"))
    starts = [(i + 1) * n - 60 for i in range(6)]
    for s, p in zip(starts, passages, strict=True):
        text[s : s + 300] = p
    rows = [(1, "\n".join(p.decode() for p in passages)), (2, text.decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in remove_repeats(df).select("doc_id", "spans").collect()}
    assert got == {1: [], 2: [(s, s + 300) for s in starts]}


def test_passages_at_cuts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passages = [noise(n) for n in (110, 140, 190, 260)]
    rows = [(i, noise(40) + p + noise(40)) for i, p in enumerate(passages)]
    # The passages start at every distance from a cut, in documents of several pieces.
    rows += [(100 + at, noise(at) + passages[at % 4] + noise(rnd.randint(150, 700))) for at in range(60, 640, 3)]
    rows += [(1000 + at, noise(at) + passages[at % 4][at % 37 :] + noise(rnd.randint(0, 500))) for at in range(200, 330)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in removal_digests(remove_repeats(df)).collect()}
    assert got == brute(rows)


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_a_batch_is_decided_in_slices(monkeypatch):
    rnd = random.Random(4)
    texts = [bytes(rnd.randrange(97, 123) for _ in range(rnd.randint(0, 900))) for _ in range(300)]
    flags = [[p << 4 | (1 if p % 2 else 6) for p in range(len(t) + 1)] for t in texts]
    runs = [None if i % 5 == 0 else [{"a": a, "b": a + 9} for a in range(0, len(t) - 110, 200)] for i, t in enumerate(texts)]
    starts = [[len(t) - 100] if len(t) > 100 and i % 3 else None for i, t in enumerate(texts)]
    run_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    ids = pa.array(range(len(texts)))
    batch = pa.record_batch(
        [ids, ids, pa.array(texts), pa.array(runs, run_type), pa.array(starts, pa.list_(pa.int64()))], names=list("abcde")
    )
    marked = pa.record_batch([ids, ids, pa.array(texts), pa.array(flags, pa.list_(pa.int64()))], names=list("abcd"))
    whole = [c.to_pylist() for c in suffix_dedup._cut(batch)]
    for text, covered, single, spans, kept in zip(texts, runs, starts, *whole, strict=True):
        gone = {p for r in covered or [] for p in range(r["a"], r["b"] + LENGTH)} | {p for s in single or [] for p in range(s, s + LENGTH)}
        assert kept == bytes(x for p, x in enumerate(text) if p not in gone)
        assert {p for s in spans for p in range(s["start"], s["end"])} == gone

    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 5000)
    parts = list(suffix_dedup.text_slices(batch, 2))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == len(texts)
    assert max(sum(map(len, p.column(2).to_pylist())) for p in parts) < 5000 + 900
    sliced = [suffix_dedup._cut(p) for p in parts]
    assert [[x for c in column for x in c.to_pylist()] for column in zip(*sliced, strict=True)] == whole

    hot = np.array([], dtype=np.int64)
    opened = [suffix_dedup._open(p, hot, 1 << 22) for p in suffix_dedup.text_slices(marked, 2)]
    want = [c.to_pylist() for c in suffix_dedup._open(marked, hot, 1 << 22)]
    assert [[x for c in column for x in c.to_pylist()] for column in zip(*opened, strict=True)] == want
    assert sum(map(len, want[0])) > 500 and sum(len(w["ranks"]) for x in want[1] for w in x) > 50_000
