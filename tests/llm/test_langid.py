import unicodedata
import zlib

import numpy as np
import pytest

from sliceforge.llm import langid
from sliceforge.llm.langid import (
    FEATURES,
    LEXICON,
    Model,
    _labeller,
    _pair_marginals,
    forward_backward,
    keep_identified,
    language_id,
    train_model,
    words_of,
)

from .conftest import edge_rows

SF = "/root/testdata/sf0.001"


def brute_marginals(scores, transition):
    n, k = scores.shape
    total, out = 0.0, np.zeros_like(scores)
    for path in np.ndindex(*[k] * n):
        s = sum(scores[i, y] for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False))
        total += np.exp(s)
        for i, y in enumerate(path):
            out[i, y] += np.exp(s)
    return out / total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 6, 2])
    scores, transition = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    got = forward_backward(scores, transition, lengths)
    at = 0
    for n in lengths:
        assert np.allclose(got[at : at + n], brute_marginals(scores[at : at + n], transition))
        at += n


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    return rows, language_id(docs).collect()


def test_held_out_accuracy(predicted):
    rows, got = predicted
    assert len(got) == len(rows)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_rows(edge_docs):
    got = language_id(edge_docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in edge_rows())
    no_letters = {str(i) for i, t, *_ in edge_rows() if not any(unicodedata.category(c)[0] == "L" for c in t or "")}
    for r in got:
        assert (r["lang_pred"] == "und") == (str(r["doc_id"]) in no_letters)
        assert r["lang_pred"] in {"und", "de", "en", "fr", "la"}
        assert (r["score"] == 0) == (r["lang_pred"] == "und")
    kept = keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns
    assert not {str(r["doc_id"]) for r in kept.collect()} & no_letters


def test_prediction_reads_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    swapped = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'xx', lang) AS lang", "'z' AS source")
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id(docs).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id(swapped).collect()}
    assert a == b


def test_words_switch_language_within_a_text():
    lexicon = np.zeros((LEXICON, 2))
    model = Model(["a", "b"], np.zeros((FEATURES, 2), dtype=np.float32), lexicon, np.eye(2), np.array([[2.0, 0.0], [0.0, 2.0]]))
    scores = np.array([[3.0, 0.0]] * 5 + [[0.0, 0.1]] + [[0.0, 3.0]] * 5)
    post = forward_backward(scores, model.transition, np.array([11]))
    assert post.argmax(axis=1).tolist() == [0] * 5 + [1] + [1] * 5
    assert _labeller(model)(["", "1 2 3", None or "x y"])[0][:2] == ["und", "und"]


def test_no_labels_and_empty_table(edge_docs, no_docs):
    assert {r["lang_pred"] for r in language_id(edge_docs.drop("lang").selectExpr("*", "cast(null as string) AS lang")).collect()} == {"und"}
    assert language_id(no_docs).count() == 0
    assert keep_identified(no_docs).count() == 0


def by_category(text):
    """Words by the categories of their characters."""
    out, word = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_words_are_letters_with_their_marks():
    assert words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert words_of("½ ² ① Ⅷ _ 3") == []
    for text in ("x² a½b", "İstanbul e\u0301te\u0301 ẞ", "it's l'hôtel 12th naïve", "\u0301abc", "日本語 тест_тест", "a\u0308" * 3):
        assert words_of(text) == by_category(text)


def test_numbers_and_marks_alone_are_undetermined(spark):
    rows = [(i, "der die das und ist nicht ein", "de") for i in range(20)] + [(50 + i, "the and of is not a", "en") for i in range(20)]
    rows += [(100, "½ ² ① Ⅷ", "en"), (101, "\u0301 \u0308 12", "de"), (102, "② die", "de")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "de"


def test_every_letter_of_a_long_word_counts(monkeypatch):
    rng = np.random.default_rng(0)
    model = Model(["a", "b"], rng.normal(size=(FEATURES, 2)), np.zeros((LEXICON, 2)), np.eye(2), np.eye(2))
    word = "".join(rng.choice(list("abcdef"), 300))
    other = word[:150] + "zzzz" + word[154:]
    whole = model.emissions([word, other, "short"])
    assert not np.allclose(whole[0], whole[1])
    monkeypatch.setattr(langid, "FEATURE_CHARS", 64)  # the same in stretches
    assert np.allclose(model.emissions([word, other, "short"]), whole, atol=1e-5)


def test_expected_transitions_equal_all_paths():
    rng = np.random.default_rng(3)
    scores, move = rng.normal(size=(2 * 4, 3)), rng.normal(size=(3, 3))
    want = np.zeros((3, 3))
    for q in range(2):
        s, total, seen = scores[4 * q : 4 * q + 4], 0.0, np.zeros((3, 3))
        for path in np.ndindex(3, 3, 3, 3):
            w = np.exp(sum(s[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for a, b in zip(path, path[1:], strict=False):
                seen[a, b] += w
        want += seen / total
    assert np.allclose(_pair_marginals(scores, move, 2, 4), want)


def test_copies_and_long_texts_in_the_sample_and_many_languages(spark):
    """A group of copies is one text of the sample, and a language of long texts
    only is learned too."""
    rows = [(i, "ab ba " * 5, "copied") for i in range(60)] + [(100 + i, f"abba baab {'ab' * i}", "copied") for i in range(5)]
    rows += [(200, "xyzzy zyxxy " * 3000, "long")]
    rows += [(300 + i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 4, f"l{i:03d}") for i in range(230)]
    model = train_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=6)
    assert len(model.languages) == 232
    label = _labeller(model)
    assert label(["xyzzy zyxxy xyzzy"])[0] == ["long"]
