import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sliceforge.llm import packing
from sliceforge.llm.bytebpe import load, split_texts, vocabulary_path
from sliceforge.llm.packing import IdTable, best_fit_plan, pack_documents

from .conftest import edge_rows


def expected_pieces(rows, capacity):
    library = Tokenizer.from_file(vocabulary_path())
    out = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or capacity
        bounds = [0, *range(head, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            out[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    return out


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(edge_docs, capacity):
    rows = pack_documents(edge_docs, capacity=capacity).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected_pieces(edge_rows(), capacity)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lower = -(-sum(r["length"] for r in rows) // capacity)
    assert len(bins) <= lower * 1.05 + 1


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_every_constraint_holds(score):
    rng = np.random.default_rng(1)
    histogram = dict(Counter(rng.integers(1, 101, 3000).tolist()))
    max_docs, max_cost = 5, 4500
    histogram = {k: v for k, v in histogram.items() if k * k <= max_cost}
    plan, n = best_fit_plan(histogram, 100, max_docs, max_cost, score)
    bins = defaultdict(list)
    seen = Counter()
    for length, ordinal, count, seq, offset in plan:
        assert ordinal == seen[length]
        seen[length] += count
        for i in range(count):
            bins[seq + i].append((offset, length))
    assert seen == Counter(histogram) and len(bins) == n
    for parts in bins.values():
        assert len(parts) <= max_docs
        assert sum(x * x for _, x in parts) <= max_cost
        assert sum(x for _, x in parts) <= 100
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_empty_table(no_docs):
    assert pack_documents(no_docs).count() == 0


def test_texts_are_split_like_the_library():
    vocab = load(vocabulary_path())
    rng = random.Random(4)
    letters = "  \n\t\xa0abstredlvmZé'’-.,19½²'' \x00"
    for _ in range(1500):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(5))]
        texts = [t for t in texts if not vocab.unstable.search(t)]
        want = [[t[a:b] for _, (a, b) in vocab.library.pre_tokenizer.pre_tokenize_str(t)] for t in texts]
        tokens, counts = split_texts(texts, vocab.classes)
        assert tokens.to_pylist() == [x for w in want for x in w] and counts.tolist() == list(map(len, want))


def test_ids_of_any_text_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_SIZE", 5)
    library = Tokenizer.from_file(vocabulary_path())
    table = IdTable(vocabulary_path())
    texts = ["it's we'll 'tis", "", "東京 \U0001f600 text", "a <|endoftext|> b", "word " * 50 + "z" * 90, " \n\n x"]
    for _ in range(3):
        for raw, text in zip(table.encode(texts), texts, strict=True):
            assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(table.recent) <= 5 + 40 and len(table.older) <= 5 + 40
