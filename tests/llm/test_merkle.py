import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sliceforge.llm.merkle import (
    COLUMNS,
    build_subtree,
    levels_for,
    merkle_manifest,
    nodes_in,
    sibling_paths,
    veb_places,
    verification_digests,
    without_line_ends,
)

from .conftest import edge_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of nodes from the leaves to the one that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)])
    return levels


def siblings(levels, i):
    """(before, behind) per level, and the place in the next level."""
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def expected(rows):
    """The contract by hand: rows of (doc_id, text, lang, source)."""
    groups = defaultdict(list)
    for i, t, lang, source in rows:
        n = None if t is None else len(t)
        leaf = leaf_of([i, source, lang, n, t])
        cut = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        groups[source].append((-1 if i is None else i, leaf, leaf_of([i, source, lang, n, cut])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        trees[name] = climb([leaf for _, leaf, _ in groups[name]])
    top = climb([trees[name][-1][0] for name in names])
    root = top[-1][0]
    out = Counter()
    for g, name in enumerate(names):
        for k, (i, leaf, shown) in enumerate(groups[name]):
            path = siblings(trees[name], k) + siblings(top, g)
            folded = shown
            for a, b in path:
                folded = sha(a + folded + b)
            proof = sha("".join(a + b for a, b in path))
            out[(None if i == -1 else i, leaf, trees[name][-1][0], root, proof, folded, folded == root)] += 1
    return out


def computed(df, height):
    rows = verification_digests(merkle_manifest(df, presented=without_line_ends(), height=height)).collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 7])
def test_places_of_the_layout(levels):
    seen = []
    for depth in range(levels):
        places = veb_places(depth, np.arange(3**depth), levels)
        seen += places.tolist()
    assert sorted(seen) == list(range(nodes_in(levels)))
    assert veb_places(0, np.arange(1), levels)[0] == 0
    if levels > 1:  # the upper half comes first, then each subtree below it as a whole
        upper = levels // 2
        first = veb_places(upper, np.arange(3**upper), levels)
        assert first.tolist() == [nodes_in(upper) + j * nodes_in(levels - upper) for j in range(3**upper)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80])
def test_subtree_against_plain_levels(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = climb(leaves)
    h = levels_for(n)
    assert h == len(levels) - 1
    store = build_subtree(leaves, h)
    assert store[0].tobytes().hex() == levels[-1][0]
    before, behind = sibling_paths(store, n, h)
    for i in range(n):
        assert list(zip(before[i], behind[i], strict=True)) == siblings(levels, i)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_of_edge_rows(edge_docs, height):
    assert computed(edge_docs, height) == expected([r[:4] for r in edge_rows()])


def test_many_rounds_and_groups(spark):
    rows = [(i * 7 % 5000, f"text {i}\n" * (i % 3), "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 40}") for i in range(800)]
    rows += [(9, "same", "en", "hot")] * 90
    df = spark.createDataFrame([(i, s, lang, len(t), t) for i, t, lang, s in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert computed(df.repartition(5), 2) == expected(rows)


def test_one_row_and_none(spark, no_docs):
    df = spark.createDataFrame([(7, None, None, 1, "a")], "doc_id long, source string, lang string, n_chars long, text string")
    assert computed(df, 6) == expected([(7, "a", None, None)])
    empty = verification_digests(merkle_manifest(no_docs))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "leaf"]


def test_any_changed_field_is_seen(spark):
    df = spark.createDataFrame([(i, "s", "en", 3, f"t{i}") for i in range(10)], "doc_id long, source string, lang string, n_chars long, text string")
    for field in COLUMNS[1:]:
        rows = merkle_manifest(df, presented=lambda c, n, field=field: c if n != field else c + 1 if n == "n_chars" else c.substr(1, 0))
        assert {r.verified for r in verification_digests(rows).collect()} == {False}
