"""Long texts cost linear time, and the packer's failures fail their document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sliceforge.functions.sentences import get_splitter
from sliceforge.functions.tokens import get_counter
from sliceforge.operators.chunker import Measure, TokenMeasure, _pack_one, bisect_piece, chunk_documents
from sliceforge.plans.import_job import prepare, processing_state_table
from sliceforge.config import ChunkOptions
from sliceforge.sources.corpus import corpus_from_table


def _timed(fn):
    fn()  # warm-up: code generation, Python workers
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def test_runs_of_marks(spark):
    df = spark.createDataFrame([("." * 40_000 + "x",), ("!?. " * 5_000,)], "t string")
    split = lambda: df.select(F.size(get_splitter("lossless")(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in split()] == [1, 5_000]
    assert _timed(split) < 2


@pytest.mark.parametrize("engine", ["arrow", "catalyst"])
def test_long_word_and_long_document(spark, engine):
    word = "a" * 16_000 + "!" * 16_000
    rows = chunk_documents(spark.createDataFrame([("1", word)], "doc_id string, text string"), 64, strategy="sentence", engine=engine)
    got = [r["text"] for r in rows.orderBy("number").collect()]
    assert "".join(got) == word and len(got) == 251 and max(len(t) for t in got[1:]) <= 64
    assert _timed(rows.collect) < 3
    text = " ".join(f"Sentence number {i} has a few words." for i in range(30_000))
    long = chunk_documents(spark.createDataFrame([("1", text)], "doc_id string, text string"), 8, engine=engine)
    assert _timed(lambda: long.agg(F.count("*")).collect()) < 6


@pytest.mark.parametrize("engine", ["arrow", "catalyst"])
def test_many_short_sentences_and_words(spark, engine):
    # 100,000 sentences of two tokens; one sentence of 100,000 words.
    for text, chunks in ((" ".join(f"s{i}." for i in range(100_000)), 25_000), (" ".join(f"w{i}" for i in range(100_000)), 12_500)):
        rows = chunk_documents(spark.createDataFrame([("1", text)], "doc_id string, text string"), 8, strategy="sentence", engine=engine)
        start = time.perf_counter()
        got = [r["text"] for r in rows.orderBy("number").select("text").collect()]
        assert len(got) == chunks and " ".join(got) == text
        assert time.perf_counter() - start < 20


def test_engines_agree_on_oversize_words_and_sentences(spark):
    rnd = random.Random(3)
    word = lambda: "-".join("ab"[: rnd.randint(1, 2)] for _ in range(rnd.choice((1, 1, 1, 2, 9))))
    docs = [(str(i), " ".join(word() + rnd.choice(("", "", "", ".", "!")) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    for limit in (1, 3, 8):
        for counter in ("regex", "chars"):
            a, b = (sorted(map(tuple, chunk_documents(df, limit, counter, "sentence", engine=e).collect())) for e in ("arrow", "catalyst"))
            assert a == b and a


def test_engines_agree_on_letters_that_are_new_in_unicode(spark):
    # Assigned after the JVM's or before Python's tables were made; either way one counter.
    new = "".join(chr(c) for c in range(0x31350, 0x313B4))
    df = spark.createDataFrame([("1", new + ". " + " ".join(new)), ("2", "ࡰࡱ " * 50 + new)], "doc_id string, text string")
    for strategy in ("greedy", "sentence"):
        a = sorted(map(tuple, chunk_documents(df, 8, strategy=strategy, engine="arrow").collect()))
        b = sorted(map(tuple, chunk_documents(df, 8, strategy=strategy, engine="catalyst").collect()))
        assert a == b
        # Strategy B starts a run with a word whole, whatever its size.
        assert strategy == "sentence" or max(r[4] for r in a) <= 9


def test_token_measure_counts_like_the_counter(spark):
    text = "a-b  (c) d_1é! ́x,y...z 東京 12.5"
    tokens = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(get_counter().token_pattern), 0)).first()[0]
    spans = [(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1)]
    df = spark.createDataFrame([(a, b, text[a:b]) for a, b in spans], "a int, b int, t string")
    want = {(r["a"], r["b"]): r["n"] for r in df.select("a", "b", get_counter().count(F.col("t")).alias("n")).collect()}
    measure = TokenMeasure(text, tokens)
    assert all(measure.tokens(a, b) == want[a, b] for a, b in spans)
    count = lambda s: len(s.split())
    assert bisect_piece("a b c d", 4, 1, count)[0][0] == "d"
    assert Measure("abc", len).fitting_parts(0, 3, 2) == [(0, 2), (2, 3)]


def test_a_text_that_the_counter_refuses_fails_its_document(spark):
    docs = spark.createDataFrame([("1", "Fine text. Two sentences."), ("2", "bad <|endoftext|> here.")], "doc_id string, text string")
    opts = ChunkOptions(factor=1 / 128, counter="bpe", extra={"encoding": "byte_bpe_50k"})
    counter = get_counter("bpe", encoding="byte_bpe_50k")
    for checked in (True, False):
        c = counter
        if not checked:  # without the check up front, the packer's own failure counts
            c = type(counter)(counter.spec)
            c.special_error = lambda text: F.lit(None).cast("string")
        rows = {r["doc_id"]: r for r in processing_state_table(prepare(corpus_from_table(docs), opts, c)).collect()}
        assert rows["1"]["is_complete"] and not rows["2"]["is_complete"]
        assert "endoftext" in rows["2"]["error_message"]


@pytest.mark.parametrize("strategy", ["greedy", "sentence"])
def test_any_failure_of_a_counter_fails_its_document_alone(strategy):
    def count(text):
        if "bad" in text:
            raise RuntimeError("no vocabulary entry")
        return len(text.split())

    assert _pack_one(["Fine text."], None, None, strategy, 4, count, "reference") == (["Fine text."], None)
    assert _pack_one(["bad text."], None, None, strategy, 4, count, "reference") == (None, "no vocabulary entry")
