"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language by forward-backward, so a text may switch
between languages; a text's language is the one with the largest expected share
of its words.  Emissions add up learned weights of affixes and character
n-grams (hashed) and a lexicon score; transitions between the labels of
neighbouring words are learned with them.

The lexicon counts words by language over all training documents; words are
hashed into a fixed number of buckets, which bounds its size.  The weights are
fitted on the driver to a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import whole_text
from .ranks import pair

#: A word: letters, with the marks that belong to them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same for texts without marks and without numbers that are no digits, which
#: the faster module takes for letters.
PLAIN_WORD = re.compile(r"[^\W\d_]+")


def _odd_characters() -> frozenset:
    """Characters on which the two patterns differ."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    letters, plain = regex.compile(r"\p{L}+"), set()
    for run in PLAIN_WORD.findall(every):
        plain.update(run)
    both = set("".join(letters.findall(every)))
    return frozenset(plain ^ both) | frozenset(regex.findall(r"\p{M}", every))


ODD = _odd_characters()
FEATURES = 1 << 16
LEXICON = 1 << 15
#: Bounds of the labelled sample that the weights are fitted to.
SAMPLE_PER_LANGUAGE = 150
SAMPLE_CHARS = 20_000
SAMPLE_WORD = 40
#: Memory bounds of a worker: words labelled at once (one longer text is a batch
#: of its own) and words whose emissions are remembered.
BATCH_WORDS = 1_000_000
MEMO_SIZE = 500_000
MEMO_CHARS = 20_000_000
#: Characters whose features are made at once; a longer word takes several turns.
FEATURE_CHARS = 1_000_000
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (``\\p{L}``, marks inside them)."""
    text = text.lower()
    return (PLAIN_WORD if text.isascii() or ODD.isdisjoint(text) else WORD).findall(text)


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word, 7) % LEXICON


def feature_parts(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words as pairs (word number, feature), each pair sorted
    by word: n-grams of two and three letters with the word's ends marked, and
    affixes of three and four letters (shorter ones are n-grams that hold an
    end).  All words are ranked at once."""
    marked = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(words))
    start = np.cumsum(size) - size
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    one = pair(letters, letters)
    ranks = {1: one}
    for n in (2, 3, 4, 5):
        ranks[n] = pair(ranks[n - 1][:-1], one[n - 1 :])
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[owner]
    parts = []
    for n in (2, 3):
        at = np.flatnonzero(place + n <= size[owner])
        parts.append((owner[at], ranks[n][at]))
    for n in (4, 5):
        long = np.flatnonzero(size >= n)
        parts += [(long, ranks[n][start[long]]), (long, ranks[n][start[long] + size[long] - n])]
    return [(o, (r >> np.uint64(40)).astype(np.int64) % FEATURES) for o, r in parts]


def _split(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about FEATURE_CHARS characters (a longer word is its own)."""
    a = chars = 0
    for i, word in enumerate(words):
        if i > a and chars + len(word) > FEATURE_CHARS:
            yield a, i
            a, chars = i, 0
        chars += len(word)
    if a < len(words):
        yield a, len(words)


def long_word_features(word: str) -> Iterator[np.ndarray]:
    """The features of one word, as :func:`feature_parts` gives them, a stretch at a
    time."""
    marked = f"^{word}$"
    for n in (2, 3):
        for a in range(0, len(marked) - n + 1, FEATURE_CHARS):
            yield _gram_features(marked[a : a + FEATURE_CHARS + n - 1], n)
    for n in (4, 5):
        if len(marked) >= n:
            yield _gram_features(marked[:n], n)
            yield _gram_features(marked[-n:], n)


def _gram_features(text: str, n: int) -> np.ndarray:
    letters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    one = ranks = pair(letters, letters)
    for k in range(2, n + 1):
        ranks = pair(ranks[:-1], one[k - 1 :])
    return (ranks >> np.uint64(40)).astype(np.int64) % FEATURES


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x L
    lexicon: np.ndarray  # LEXICON x L, log share of each language in the bucket
    lexicon_weight: np.ndarray  # L x L
    transition: np.ndarray  # L x L, scores

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words x L)."""
        sums = np.zeros((len(words), len(self.languages)))
        size = np.zeros(len(words))
        for a, b in _split(words):
            if len(words[a]) > FEATURE_CHARS:
                for features in long_word_features(words[a]):
                    sums[a] += self.weights[features].sum(axis=0)
                    size[a] += len(features)
                continue
            for owner, features in feature_parts(words[a:b]):
                if len(owner):
                    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    sums[a + owner[first]] += np.add.reduceat(self.weights[features], first, axis=0)
                    size[a:b] += np.bincount(owner, minlength=b - a)
        sums /= np.sqrt(size)[:, None]
        lex = self.lexicon[np.fromiter(map(bucket, words), dtype=np.int64, count=len(words))]
        return (sums + lex @ self.lexicon_weight).astype(np.float32)


def forward_backward(scores: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label marginals (words x L) of many sequences that lie one after the other
    in ``scores``; all sequences advance together, the ended ones drop out."""
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    size = lengths[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transition - transition.max()).astype(scores.dtype)
    alpha = np.empty_like(emit)
    beta = np.ones_like(emit)
    longest = int(size[0]) if len(size) else 0
    # active[t]: sequences longer than t.
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    prev = None
    for t in range(longest):
        rows = start[: active[t]] + t
        now = emit[rows] if prev is None else (prev[: len(rows)] @ move) * emit[rows]
        prev = now / now.sum(axis=1, keepdims=True)
        alpha[rows] = prev
    back = move.T
    for t in range(longest - 2, -1, -1):
        rows = start[: active[t + 1]] + t
        now = (beta[rows + 1] * emit[rows + 1]) @ back
        beta[rows] = now / now.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True)


def switched_sequences(docs: list[tuple[list[str], int]], rng: np.random.Generator, n: int, length: int):
    """Training sequences of ``length`` words put together from runs of words of
    random documents, with the label of each word."""
    words, labels = [], []
    for _ in range(n):
        w: list[str] = []
        y: list[int] = []
        while len(w) < length:
            text, label = docs[rng.integers(len(docs))]
            run = int(rng.integers(2, length))
            at = int(rng.integers(max(1, len(text) - run + 1)))
            part = text[at : at + run]
            w += part
            y += [label] * len(part)
        words.append(w[:length])
        labels.append(y[:length])
    return words, np.array(labels)


def fit(
    docs: list[tuple[list[str], int]],
    languages: list[str],
    lexicon: np.ndarray,
    sequences: int = 2400,
    length: int = 24,
    epochs: int = 4,
    batch: int = 100,
    rate: float = 0.2,
    decay: float = 1e-6,
    seed: int = 17,
) -> Model:
    """Maximum likelihood by AdaGrad: the gradient is the observed minus the
    expected counts of features and transitions."""
    n_lang = len(languages)
    rng = np.random.default_rng(seed)
    model = Model(
        languages,
        np.zeros((FEATURES, n_lang)),
        lexicon,
        np.eye(n_lang) * 0.5,
        np.eye(n_lang),
    )
    words, labels = switched_sequences(docs, rng, sequences, length)
    vocab = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    parts = feature_parts(list(vocab))
    owner = np.concatenate([o for o, _ in parts])
    order = np.argsort(owner, kind="stable")
    owner, feats = owner[order], np.concatenate([f for _, f in parts])[order]
    count = np.bincount(owner, minlength=len(vocab))
    width = int(count.max())
    # Features per word in a rectangle; FEATURES is a row of zeros for padding.
    table = np.full((len(vocab), width), FEATURES, dtype=np.int64)
    table[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = feats
    scale = 1 / np.sqrt((table < FEATURES).sum(axis=1, keepdims=True))
    lex = lexicon[[bucket(w) for w in vocab]]
    index = np.array([[vocab[w] for w in ws] for ws in words])
    padded = np.zeros((FEATURES + 1, n_lang))
    g_w, g_l, g_t = np.full_like(padded, 1e-2), np.full((n_lang, n_lang), 1.0), np.full((n_lang, n_lang), 1.0)
    lengths = np.full(batch, length)
    for _ in range(epochs):
        order = rng.permutation(len(index))
        for at in range(0, len(order) - batch + 1, batch):
            seqs = index[order[at : at + batch]]
            y = labels[order[at : at + batch]]
            flat = seqs.reshape(-1)
            scores = padded[table[flat]].sum(axis=1) * scale[flat] + lex[flat] @ model.lexicon_weight
            post = forward_backward(scores, model.transition, lengths)
            diff = np.eye(n_lang)[y.reshape(-1)] - post
            # Expected transitions, from neighbouring marginals of the chain.
            pair = _pair_marginals(scores, model.transition, batch, length)
            seen = np.zeros((n_lang, n_lang))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            grad_t = (seen - pair) / batch
            grad_l = lex[flat].T @ diff / batch
            cols = table[flat].ravel()
            grad_w = np.stack(
                [
                    np.bincount(cols, np.repeat(diff[:, k] * scale[flat, 0], width), FEATURES + 1)
                    for k in range(n_lang)
                ],
                axis=1,
            ) / batch - decay * padded
            grad_w[FEATURES] = 0
            for value, grad, past in ((padded, grad_w, g_w), (model.lexicon_weight, grad_l, g_l), (model.transition, grad_t, g_t)):
                past += grad * grad
                value += rate * grad / np.sqrt(past)
    model.weights = padded[:FEATURES].astype(np.float32)
    return model


def _pair_marginals(scores: np.ndarray, transition: np.ndarray, batch: int, length: int) -> np.ndarray:
    """Expected transition counts (L x L) of ``batch`` sequences of equal length."""
    n_lang = transition.shape[0]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(batch, length, n_lang)
    move = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    a = emit[:, 0]
    for t in range(length):
        a = emit[:, t] if t == 0 else (a @ move) * emit[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    before, after = alpha[:, :-1].reshape(-1, n_lang), (beta[:, 1:] * emit[:, 1:]).reshape(-1, n_lang)
    weight = ((before @ move) * after).sum(axis=1, keepdims=True)
    return move * ((before / weight).T @ after)


def lexicon_counts(train: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all training documents (lang, text).  A task adds up
    its own documents first and sends the sums when it holds many words."""

    def rows(counters: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counters.items():
            at = np.fromiter(map(bucket, words), dtype=np.int64, count=len(words))
            n = np.bincount(at, np.fromiter(words.values(), dtype=np.int64, count=len(words)), LEXICON).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(n[at])})
        counters.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counters.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counters.values())) > MEMO_SIZE:
                yield from rows(counters)
        yield from rows(counters)

    return train.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _sample_words(text: str) -> list[str]:
    return [w[i : i + SAMPLE_WORD] for w in words_of(text) for i in range(0, len(w), SAMPLE_WORD)]


def train_model(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE
) -> Model | None:
    """Model of the labelled rows of ``docs``; None without any.

    The lexicon covers all labelled rows and their whole words.  The weights are
    fitted to the first SAMPLE_CHARS characters of at most ``sample`` different
    texts per language, those of the smallest hashes; there, words of over
    SAMPLE_WORD letters are cut.  The model takes about 0.5 MB a language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), whole_text(text_col).alias("text")).filter("lang is not null")
    counts = lexicon_counts(rows).collect()  # at most LEXICON rows per language
    languages = sorted({r["lang"] for r in counts})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    n = np.zeros((LEXICON, len(languages)))
    for r in counts:
        n[r["bucket"], number[r["lang"]]] = r["n"]
    share = (n / n.sum(axis=0)) + 1e-7
    lexicon = np.log(share) - np.log(share).mean(axis=1, keepdims=True)
    # Hashes first, so that copies are one and texts are read for the picked only.
    hashed = rows.filter(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").distinct().withColumn("nth", nth).filter(F.col("nth") <= sample).select("lang", "h")
    # At most ``sample`` rows per language.
    texts = hashed.select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), ["lang", "h"])
    picked = texts.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    picked = sorted(
        ((_sample_words(r["text"]), number[r["lang"]], r["h"]) for r in picked if r["lang"] in number), key=lambda r: (r[1], r[2])
    )
    # Equal shares of the languages, so that none is favoured by its sample.
    by_lang = [[(w, k) for w, k, _ in picked if k == lang and w] for lang in range(len(languages))]
    most = max(map(len, by_lang), default=0)
    docs_ = [d[i % len(d)] for d in by_lang if d for i in range(most)]
    if not docs_:
        return None
    return fit(docs_, languages, lexicon)


def _labeller(model: Model | None):
    memo: dict[str, int] = {}
    chars = [0]
    known = [np.empty((0, len(model.languages) if model else 0), dtype=np.float32)]

    def index(words: list[str]) -> np.ndarray:
        at = list(map(memo.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at, strict=True) if i is None))
            first = len(memo)
            memo.update((w, first + i) for i, w in enumerate(new))
            chars[0] += sum(map(len, new))
            rows = model.emissions(new)
            if first + len(new) > len(known[0]):
                grown = np.empty((max(4096, 2 * (first + len(new))), rows.shape[1]), dtype=np.float32)
                grown[:first] = known[0][:first]
                known[0] = grown
            known[0][first : first + len(new)] = rows
            at = list(map(memo.__getitem__, words))
        return np.array(at, dtype=np.int32)

    def label(texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        langs, scores, sizes = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if model is None:
            return langs, scores, sizes
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            lengths = np.array([len(x) for _, x in held])
            post = forward_backward(known[0][np.concatenate([x for _, x in held])], model.transition, lengths)
            start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            share = np.add.reduceat(post, start, axis=0, dtype=np.float64) / lengths[:, None]
            best = share.argmax(axis=1)
            for (i, _), k, row in zip(held, best.tolist(), share, strict=True):
                langs[i], scores[i] = model.languages[k], float(min(1.0, max(0.0, row[k])))
            held.clear()
            if len(memo) > MEMO_SIZE or chars[0] > MEMO_CHARS:
                memo.clear()
                chars[0] = 0

        total = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            if not words:
                continue
            if total + len(words) > BATCH_WORDS:
                flush()
                total = 0
            held.append((i, index(words)))
            total += len(words)
        flush()
        return langs, scores, sizes

    return label


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> F.Column:
    """A struct column (lang_pred, score, n_words) for ``df``'s text."""
    label = _labeller(model)

    @F.pandas_udf("lang_pred string, score double, n_words long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, sizes = label(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "n_words": sizes})

    return run(whole_text(text_col))


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, divisible by 5; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, n_words.

    The model is trained on the labelled rows that are not held out; a
    prediction reads the text alone.  Defined cases: a null text or one without
    letters is ``und`` with score 0, as is every text if no row is labelled; a
    null language is no label; repeated rows and null ids are treated like any
    other; ties go to the language that comes first by name; texts of any length
    are labelled whole; an empty table gives no rows; other columns are ignored.
    """
    model = train_model(df.filter(~held_out(id_col)), text_col, lang_col)
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), identify(df, model, text_col).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.n_words")


def keep_identified(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3
) -> DataFrame:
    """``df`` without the rows whose language is undetermined or whose best
    language has less than ``min_score`` of the words; all its columns."""
    model = train_model(df.filter(~held_out(id_col)), text_col, lang_col)
    rows = df.withColumn("__p", identify(df, model, text_col))
    rows = rows.filter((F.col("__p.lang_pred") != UNDETERMINED) & (F.col("__p.score") >= min_score))
    return rows.drop("__p")
