"""Token counters: JVM and Python forms agree; BPE round trip; fallback."""

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sliceforge.functions.tokens import (
    TOKEN_PATTERN_JAVA,
    TOKEN_PATTERN_PY,
    CounterSpec,
    get_counter,
    py_counter,
    resolve_counter,
)

from .conftest import SF_SMALL

TRICKY = [
    "Hello, wörld_1 3.14!　x y \x1c z  é \U0001F600 — ok\x85.",
    "tab\tsep\x0bvt\x0cff ls ps nn mm",
    "",
    "...",
    "日本語のテキスト。次の文",
]


def test_regex_counter_jvm_equals_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    extra = spark.createDataFrame([(t,) for t in TRICKY], "text string")
    rows = docs.unionByName(extra).select("text", get_counter("regex").count(F.col("text")).alias("n")).collect()
    count = py_counter(CounterSpec("regex"))
    assert all(count(r.text) == r.n for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!?,\n\t 　é1_-") + ["\U0001F600"]), max_size=40))
def test_regex_python_counts_tokens(text):
    assert py_counter(CounterSpec("regex"))(text) == len(regex.findall(TOKEN_PATTERN_PY, text))


def test_bpe_round_trip_and_count(spark):
    c = get_counter("bpe", encoding="byte_bpe_50k", on_special="text")
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    out = df.select(
        "text", c.count(F.col("text")).alias("n"), c.encode(F.col("text")).alias("ids")
    ).select("text", "n", "ids", c.decode(F.col("ids")).alias("back")).collect()
    count = py_counter(CounterSpec("bpe", encoding="byte_bpe_50k", on_special="text"))
    assert all(r.back == r.text and r.n == len(r.ids) == count(r.text) for r in out)


def test_fallback_is_reported():
    counter, splitter, fell_back = resolve_counter("bpe", encoding="no-such-encoding")
    assert fell_back and counter.name == "regex" and splitter == "lossless"
    counter, splitter, fell_back = resolve_counter("bpe", encoding="byte_bpe_50k")
    assert not fell_back and counter.name == "bpe" and splitter == "dot"


def test_vocabulary_decode(spark):
    from sliceforge.functions.tokens import decode_with_vocabulary, vocabulary

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, ""), (-2, "the the the")], "doc_id long, text string"))
    enc = docs.select("doc_id", get_counter("regex").encode(F.col("text")).alias("ids"))
    tokens = F.regexp_extract_all("text", F.lit(TOKEN_PATTERN_JAVA), 0)
    want = {r.doc_id: r.decoded for r in docs.select("doc_id", F.array_join(tokens, " ").alias("decoded")).collect()}
    got = {r.doc_id: r.decoded for r in decode_with_vocabulary(enc, vocabulary(docs)).collect()}
    assert got == want and got[-1] == ""


def test_bpe_chunking_equals_python_model(spark):
    """The BPE queries have no SQL oracle; check them against the Python helpers."""
    import hashlib
    import re

    from sliceforge.operators.chunker import chunk_documents, pack_greedy, pack_sentences

    spec = CounterSpec("bpe", encoding="byte_bpe_50k", on_special="text")
    count = py_counter(spec)
    bpe = get_counter("bpe", encoding="byte_bpe_50k", on_special="text")
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for strategy, limit in (("greedy", 256), ("sentence", 64)):
        got = sorted((r.doc_id, r.number, r.tokens, r.content_hash) for r in chunk_documents(rows, limit, bpe, strategy=strategy).collect())
        want = []
        for d, t in texts.items():
            if strategy == "greedy":
                chunks = pack_greedy([s.strip() + "." for s in t.split(".") if s.strip()], limit, count)
                first = 1
            else:
                chunks = pack_sentences([s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()], limit, count)
                first = 0
            want += [(d, first + i, count(c), hashlib.md5(c.encode()).hexdigest()) for i, c in enumerate(chunks)]
        assert got == sorted(want), strategy


def test_vocabulary_by_path():
    import public_tokenizers

    by_name = py_counter(CounterSpec("bpe", encoding="byte_bpe_50k", on_special="text"))
    by_path = py_counter(CounterSpec("bpe", encoding=public_tokenizers.path("byte_bpe_50k.tiktoken"), on_special="text"))
    for text in ("Hello there, it's 2024.", "  naïveté\n\n東京 ", ""):
        assert by_name(text) == by_path(text)


def test_decoding_long_rows_takes_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from sliceforge.functions.tokens import decode_with_vocabulary, regex_encode, vocabulary

    text = " ".join(f"w{i % 20_000}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    enc = docs.select("doc_id", regex_encode(F.col("text")).alias("ids"))
    vocab = vocabulary(docs).where("token <> 'b'")
    start = time.perf_counter()
    got = {r.doc_id: r.decoded for r in decode_with_vocabulary(enc, vocab).collect()}
    assert got == {1: text, 2: "a", 3: "", 4: ""}
    assert time.perf_counter() - start < 30
    again = vocab.unionByName(vocab.where("token = 'a'").selectExpr("id", "'other' AS token"))
    with pytest.raises(Exception, match="two tokens of one id"):
        decode_with_vocabulary(enc, again).collect()


def test_bpe_functions_keep_few_rows_as_objects():
    import pyarrow as pa

    from sliceforge.functions.tokens import ROWS_AT_ONCE, in_slices

    seen = []

    def work(rows):
        seen.append(len(rows))
        return [None if r is None else len(r) for r in rows]

    texts = [None if i % 7 == 0 else "x" * i for i in range(300)]
    got = in_slices(pa.int32(), work, pa.array(texts, pa.string()))
    assert got.to_pylist() == [None if t is None else len(t) for t in texts]
    assert max(seen) <= ROWS_AT_ONCE and sum(seen) == 300
    assert in_slices(pa.int32(), work, pa.array([], pa.string())).to_pylist() == []
