import random

from tokenizers import Tokenizer

from sliceforge.llm.bytebpe import load, vocabulary_path
from sliceforge.llm.token_counts import count_symbols, token_counts

from .conftest import edge_rows


def test_counts_are_the_librarys(edge_docs):
    library = Tokenizer.from_file(vocabulary_path())
    want = sorted(
        (-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t, *_ in edge_rows()
    )
    rows = token_counts(edge_docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def test_merging_on_random_strings():
    vocab = load(vocabulary_path())
    library = vocab.library
    rnd = random.Random(5)
    alphabet = "aaabehlost  .,'éß東\n<|>🙂١ a"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        parts, _ = vocab.pretokens(t)
        assert parts == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)] or "<|endoftext|>" in t
    words = [t.encode() for t in texts]
    # Each text as one sequence of bytes, whatever its pre-tokens would be.
    want = [len(vocab.ids_of(t)) for t in texts]
    assert count_symbols(words, vocab).tolist() == want


def test_empty_table(no_docs):
    assert token_counts(no_docs).count() == 0
