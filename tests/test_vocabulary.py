"""Dense integer vocabularies: ids without gaps that stay over extensions."""

import hashlib
import os
import random
from concurrent.futures import ThreadPoolExecutor

import regex
from pyspark.sql import functions as F

from sliceforge.functions.tokens import TOKEN_PATTERN_PY, decode_with_vocabulary
from sliceforge.operators import vocabulary as module
from sliceforge.operators.vocabulary import decode_texts, encode_texts, extend_vocabulary, read_vocabulary
from sliceforge.plans.catalog import queries
from sliceforge.session import ensure_checkpoint_dir

from .conftest import SF_SMALL

SCHEMA = "doc_id long, text string"


def tokens(text):
    return regex.findall(TOKEN_PATTERN_PY, text or "")


def brute(texts, first=0, known=()):
    new = {t for x in texts for t in tokens(x)} - set(known)
    return {t: first + i for i, t in enumerate(sorted(new, key=lambda t: t.encode()))}


def table(spark, root, version=None):
    rows = read_vocabulary(spark, root, version).collect()
    assert sorted(r.id for r in rows) == list(range(len(rows)))  # dense, no id twice
    return {r.token: r.id for r in rows}


def test_ids_are_dense_and_stay(spark, tmp_out):
    root = f"{tmp_out}/vocabulary"
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    first = extend_vocabulary(docs.repartition(5), root)
    want = brute(texts)
    assert first == {"version": 0, "size": len(want), "added": len(want)} and table(spark, root) == want
    assert extend_vocabulary(docs.repartition(3), root) == {"version": 0, "size": len(want), "added": 0}
    more = spark.createDataFrame([(1, "zebra Zebra été \U0001f600 qqqq"), (2, None), (3, "")], SCHEMA)
    second = extend_vocabulary(more, root)
    want |= brute(["zebra Zebra été \U0001f600 qqqq"], len(want), want)
    assert second["version"] == 1 and second["size"] == len(want) and table(spark, root) == want
    assert table(spark, root, version=0) == {t: i for t, i in want.items() if i < first["size"]}


def test_encode_and_decode(spark, tmp_out, monkeypatch):
    # Every share of hot values: none (of the words), some, all.
    rows = [(i, f"the a{i % 7} b{i} , the the.") for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n "), (5, "a second row of id 5"), (None, "no id a1"), (None, "none b2 either")]
    rows += [(63, "w1 " * 5_000 + " ".join(f"x{i}" for i in range(3_000)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    root = f"{tmp_out}/vocabulary"
    extend_vocabulary(docs, root)
    ids = table(spark, root)
    for share in (1, 30, 1_000, 10**9):
        monkeypatch.setattr(module, "HOT_SHARE", share)
        vocab = read_vocabulary(spark, root)
        encoded = encode_texts(docs, vocab)
        assert encoded.schema["ids"].dataType.simpleString() == "array<bigint>"
        got = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
        assert got == sorted(((i, None if t is None else [ids[x] for x in tokens(t)]) for i, t in rows), key=str)
        back = sorted(((r.doc_id, r.decoded) for r in decode_texts(encoded, vocab).collect()), key=str)
        assert back == sorted(((i, None if t is None else " ".join(tokens(t))) for i, t in rows), key=str)


def test_unknown_tokens_and_ids(spark, tmp_out):
    root = f"{tmp_out}/vocabulary"
    extend_vocabulary(spark.createDataFrame([(1, "one two")], SCHEMA), root)
    vocab = read_vocabulary(spark, root)
    encoded = encode_texts(spark.createDataFrame([(1, "two three one"), (2, "four")], SCHEMA), vocab)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {1: [1, -1, 0], 2: [-1]}
    assert {r.doc_id: r.decoded for r in decode_texts(encoded, vocab).collect()} == {1: "two � one", 2: "�"}


def test_empty_texts_make_an_empty_vocabulary(spark, tmp_out):
    root = f"{tmp_out}/vocabulary"
    none = spark.createDataFrame([], SCHEMA)
    assert extend_vocabulary(none, root) == {"version": 0, "size": 0, "added": 0}
    assert read_vocabulary(spark, root).count() == 0
    assert encode_texts(none, read_vocabulary(spark, root)).count() == 0
    assert extend_vocabulary(spark.createDataFrame([(1, "b a")], SCHEMA), root)["added"] == 2
    assert table(spark, root) == {"a": 0, "b": 1}


def test_extensions_at_the_same_time(spark, tmp_out):
    root = f"{tmp_out}/vocabulary"
    texts = [f"shared words w{i} w{i + 1} only{i}" for i in range(4)]
    frames = [spark.createDataFrame([(i, t)], SCHEMA) for i, t in enumerate(texts)]
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda f: extend_vocabulary(f, root), frames))
    ids = table(spark, root)
    assert set(ids) == {t for x in texts for t in tokens(x)}
    assert sorted(d["version"] for d in done) == [0, 1, 2, 3] and sum(d["added"] for d in done) == len(ids)
    assert read_vocabulary(spark, root).groupBy("token").count().where(F.col("count") > 1).count() == 0


def test_slices_of_any_size_give_the_same(spark, tmp_out, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 40))) for i in range(120)]
    rows += [(7, None), (None, "w1 w2"), (None, "w3"), (200, " ".join(f"x{k}" for k in range(900)))]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    root = f"{tmp_out}/vocabulary"
    extend_vocabulary(docs, root)
    ids, vocab = table(spark, root), read_vocabulary(spark, root)
    want = sorted(((i, None if t is None else [ids[x] for x in tokens(t)]) for i, t in rows), key=str)
    for share in (1, 10**9):
        for sizes in ((1, 1, 1), (300, 50, 7), (300, 10**6, 1_000)):
            monkeypatch.setattr(module, "HOT_SHARE", share)
            for name, n in zip(("SLICE_TOKENS", "SLICE_VALUES", "PIECE_VALUES"), sizes, strict=True):
                monkeypatch.setattr(module, name, n)
            got = encode_texts(docs, vocab).collect()
            assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want


def test_ids_of_other_forms_are_decoded(spark):
    md5 = hashlib.md5(b"a").hexdigest()
    vocab = spark.createDataFrame([("7", "seven"), (md5, "a"), (md5.upper(), "A"), (md5 + "\n", "n"), ("", "none")], "id string, token string")
    rows = [(1, ["7", md5, "9", md5.upper(), None, md5 + "\n", ""]), (2, None), (3, [])]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<string>")
    got = {r.doc_id: r.decoded for r in decode_with_vocabulary(encoded, vocab).collect()}
    assert got == {1: "seven a A n none", 2: "", 3: ""}


def test_decoding_writes_little_more_than_the_texts(spark, tmp_out, monkeypatch):
    monkeypatch.setattr(module, "HOT_SHARE", 1)  # words of few documents, as most are in a large table
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.randrange(20_000):x}" for _ in range(400))) for i in range(1_500)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_out}/documents.parquet")
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    places = [*local, ensure_checkpoint_dir(spark).removeprefix("file:")]

    def files():
        found = [os.path.join(at, f) for place in places for at, _, names in os.walk(place) for f in names]
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    before = files()
    got = {r.doc_id: (r.decoded_md5, r.n_tokens) for r in queries()["vocabulary_decode"](spark, tmp_out).collect()}
    written = sum(n for f, n in files().items() if f not in before)
    assert got == {str(i): (hashlib.md5(t.encode()).hexdigest(), len(t.split())) for i, t in rows}
    assert written < 4 * sum(len(t) for _, t in rows)
