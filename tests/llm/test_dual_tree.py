import math
from collections import Counter

import numpy as np
import pytest
import regex

from sliceforge.llm import dual_tree
from sliceforge.llm.dual_tree import LOWER, maxima, ranked_search, surviving_pairs

from .conftest import CLASHING, edge_rows

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=10):
    """All scores of all documents, in plain integers: rows of (id, text)."""
    docs = [(i, words(t)) for i, t in docs]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, w, c in docs:
            m = 25 + 75 * len(w) * n_docs // n_terms
            s = 0
            for t in words(text):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += weight * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if s:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ITEMS = [
    (1, "der speisewagen bleibt heute leider GESCHLOSSEN"),
    (2, "short document number 3 of the hot source"),
    (3, None),
    (4, " ... "),
    (5, "nothing of this occurs xyzzy"),
    (6, "lorem lorem ipsum"),
    (7, "\U0001f600 東京 naïveté"),
    (8, "no id at all"),
    (8, "repeated row"),
    (8, "repeated row"),
]


def computed(df, items, **options):
    return Counter(tuple(r) for r in ranked_search(df, items, **options).collect())


@pytest.mark.parametrize("options", [{}, {"k": 3, "tree_docs": 5}, {"set_pairs": 6, "tree_docs": 16}])
def test_edge_rows(spark, edge_docs, options):
    clash = [c for c in CLASHING if c not in ("item", "term", "times")]
    rows = [(i, t, *["x"] * len(clash)) for i, t in ITEMS]
    items = spark.createDataFrame(rows, ", ".join(["item_id long", "text string", *(f"`{c}` string" for c in clash)]))
    found = computed(edge_docs, items, **options)
    assert found == by_hand([r[:2] for r in edge_rows()], ITEMS, options.get("k", 10))


def test_random_texts_ties_and_hot_terms(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61) ** 1.2
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(int(i), text(rng.integers(1, 40))) for i in rng.permutation(400)]
    docs += [(1000 + i, "w0 w1 w59") for i in range(150)]  # copies: ties by id
    items = [(i, text(rng.integers(1, 12))) for i in range(40)] + [(99, "w59 w1 w0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = by_hand(docs, items)
    for tree_docs in (32, 2048):
        assert computed(df, spark.createDataFrame(items, "item_id long, text string"), tree_docs=tree_docs) == want


def test_ids_may_be_strings(spark):
    docs = [("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "x")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    rows = ranked_search(df, spark.createDataFrame([("q", "y")], "item_id string, text string")).collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(rows, key=lambda r: r.rank)] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


def test_empty_tables(spark, no_docs, edge_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(no_docs, items).count() == 0
    assert ranked_search(edge_docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search(edge_docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_bounds_lose_no_pair(kind):
    rng = np.random.default_rng(5)
    for rows, cols in ((1, 1), (5, 70), (64, 65), (3, 700)):
        items = rng.integers(0, 9, (rows, 12)) * (rng.random((rows, 12)) < 0.3)
        docs = rng.integers(0, 9, (cols, 12)) * (rng.random((cols, 12)) < 0.3)
        weakest = rng.integers(0, 120, rows)
        i, d, s = surviving_pairs(maxima(items.astype(kind)), maxima(docs.astype(kind)), weakest)
        full = items @ docs.T
        want = {(a, b, full[a, b]) for a in range(rows) for b in range(cols) if full[a, b] >= max(1, weakest[a])}
        assert set(zip(i.tolist(), d.tolist(), s.astype(np.int64).tolist(), strict=True)) == want


def test_whole_batches_are_pruned(monkeypatch):
    """Documents of other terms than the items' are left at an upper node."""
    touched = []
    products = dual_tree._products
    monkeypatch.setattr(dual_tree, "_products", lambda a, b, left, right: touched.append(len(left)) or products(a, b, left, right))
    items = np.zeros((64, 20), dtype=np.int64)
    items[:, 0] = 5
    docs = np.zeros((4096, 20), dtype=np.int64)
    docs[:, 1] = 9
    docs[:3, 0] = 4
    _, d, _ = surviving_pairs(maxima(items), maxima(docs), np.zeros(64, dtype=np.int64))
    assert set(d.tolist()) == {0, 1, 2} and sum(touched) < 64 * 4096 / 100


def test_sums_beyond_doubles_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "EXACT", 1)  # the 64-bit path
    docs = [(i, "a b c " * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "a c c")]
    assert computed(df, spark.createDataFrame(items, "item_id long, text string")) == by_hand(docs, items)
