"""Catalyst text handling == Python semantics on tricky Unicode: newline
normalisation, code-point lengths (astral characters), UTF-8 sizes, MD5,
Python ``strip`` white space, and the dot-split chunks."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sliceforge.config import ChunkOptions
from sliceforge.functions.text import WS_CHARS
from sliceforge.operators.chunker import pack_greedy
from sliceforge.plans.import_job import chunks_table, prepare
from sliceforge.sources.corpus import corpus_from_table

ALPHABET = list("ab. \n\r\t") + list(WS_CHARS[:12]) + ["\U0001F600", "\u00e9", "\u0301", "\ufeff", "\u65e5", "!", "?"]


def model(text, limit):
    content = text.replace("\r\n", "\n").replace("\r", "\n")  # text-mode read
    if not content.strip():
        return None
    sentences = [s.strip() + "." for s in content.split(".") if s.strip()]
    chunks = pack_greedy(sentences, limit, len)
    stats = (len(content), content.count("\n") + 1, len(content.encode("utf-8")), hashlib.md5(content.encode()).hexdigest())
    return stats, [(i + 1, c, len(c), hashlib.md5(c.encode()).hexdigest()) for i, c in enumerate(chunks)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=80), min_size=1, max_size=5), st.sampled_from([1, 3, 10]))
def test_stats_and_chunks_match_python(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    opts = ChunkOptions(counter="chars", limit_override=limit)
    prepared = prepare(corpus_from_table(df), opts)
    docs = {r.doc_id: r for r in prepared.collect()}
    chunks = {}
    for r in chunks_table(prepared, opts).collect():
        chunks.setdefault(r.doc_id, []).append((r.number, r.text, r.tokens, r.content_hash))
    for i, t in enumerate(texts):
        want = model(t, limit)
        got = docs[str(i)]
        if want is None:
            assert not got.ok and got.error.endswith("is empty.")
            continue
        stats, want_chunks = want
        assert (got.total_chars, got.total_lines, got.file_size, got.md5_hash) == stats
        if not want_chunks:
            assert not got.ok and got.error.startswith("No chunks created")
            continue
        assert sorted(chunks[str(i)]) == want_chunks
