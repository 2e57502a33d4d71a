import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from sliceforge.llm.bytebpe import vocabulary_path
from sliceforge.llm import piece_table
from sliceforge.llm.piece_table import MODEL, ChunkTable, decode_ids, encode_texts, encoding_digests, load

from .conftest import edge_rows

PATH = vocabulary_path(MODEL)


def strings(*texts):
    return pa.array(texts, pa.large_string())


LIBRARY = SentencePieceProcessor(model_file=PATH)


def test_chunks_and_decoding_against_the_library():
    model = load(PATH)
    assert model.chunked
    rng = random.Random(3)
    letters = " \n▁\r\tab.Zé東\U0001f600\x00ﬁ'\";)(*/{}"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        ids = model.segment(model.cut(strings(text))[0].to_pylist())[0].tolist()
        assert ids == LIBRARY.encode(text)
        assert model.text_of(np.array(ids, dtype=np.int64)) == LIBRARY.decode(ids)
    for _ in range(4000):  # any ids, also ones that no text gives
        ids = [rng.choice([0, 1, 2, 35, 28705, rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert model.text_of(np.array(ids, dtype=np.int64)) == LIBRARY.decode(ids)


def test_chunks_are_segmented_together():
    model = load(PATH)
    chunks = ["\n\n", " a", "b", "\n", " ▁", " don't" * 3, "\x00", "\n\n\n"]
    flat, start = model.segment(chunks)
    for c, a, b in zip(chunks, start[:-1], start[1:], strict=True):
        assert flat[a:b].tolist() == LIBRARY.encode("\n" + c)[len(model.wall) :]
    assert len(model.segment([])[0]) == 0 and model.segment([])[1].tolist() == [0]


@pytest.mark.parametrize("slice_bytes", [4_000_000, 50])
def test_edge_rows(edge_docs, slice_bytes):
    rows = decode_ids(encode_texts(edge_docs, slice_bytes=slice_bytes)).collect()
    expected = Counter()
    for i, t, *_ in edge_rows():
        ids = LIBRARY.encode(t or "")
        expected[(i, tuple(ids), LIBRARY.decode(ids))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == expected


def test_digests(edge_docs):
    rows = encoding_digests(encode_texts(edge_docs, decoded=True)).collect()
    expected = Counter()
    for i, t, *_ in edge_rows():
        ids = LIBRARY.encode(t or "")
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), LIBRARY.decode(ids))]
        expected[(i, len(ids), *sha)] += 1
    assert Counter(tuple(r) for r in rows) == expected


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    model, seen = load(PATH), Counter()

    class Counting:
        cut = model.cut

        def segment(self, chunks):
            seen.update(chunks)
            return model.segment(chunks)

    table = ChunkTable(Counting())
    texts = ["the same words " * 200 + str(i % 3) for i in range(30)]
    for _ in range(2):  # the second slice finds all of them known
        assert table.encode(strings(*texts)).to_pylist() == [LIBRARY.encode(t) for t in texts]
    assert set(seen.values()) == {1} and len(seen) == 6
    # Over its bound the table begins again; long chunks are not remembered.
    monkeypatch.setattr(piece_table, "MEMO_SIZE", 10)
    for k in range(20):
        texts = [f"w{k}a w{k}b " + "z" * 60, "", f"w{k}c"]
        assert table.encode(strings(*texts)).to_pylist() == [LIBRARY.encode(t) for t in texts]
        assert len(table.recent) <= 16 and len(table.older) <= 16


def test_one_word_of_a_megabyte(spark):
    text = "ab" * 500_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert encode_texts(df).first().ids == LIBRARY.encode(text)


def test_empty_table_and_missing_ids(spark, no_docs):
    assert encode_texts(no_docs).count() == 0
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in decode_ids(df).collect()] == ["", ""]
