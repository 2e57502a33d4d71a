import math

import numpy as np
import pytest

from sliceforge.llm.ann import nearest_neighbours, shared_prefix

SF = "/root/testdata/sf0.001"


def brute(rows, k, every):
    """Exact lists; rows that repeat id and vector are one row."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, dtype=np.float64))
    items = [(i, v) for (i, _), v in good.items()]
    out = {}
    for i, v in items:
        if i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in items if j != i and len(w) == len(v))
            out.setdefault(i, near[:k])
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def recall(got, want):
    return np.mean([len({j for _, j in got.get(q, [])} & {j for _, j in w}) / len(w) for q, w in want.items() if w])


@pytest.mark.parametrize("part_rows", [8192, 60])
def test_recall_and_exact_scores(spark, part_rows):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = lists(nearest_neighbours(df, query_every=25, part_rows=part_rows).collect())
    want = brute(rows, 10, 25)
    assert got.keys() == want.keys()
    assert all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near)
        for s, j in near:
            assert abs(s - np.sqrt(((vec[q] - vec[j]) ** 2).sum())) < 1e-12


def test_edge_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 30)]
    same = [1.0, 2.0, 3.0, 4.0]
    rows += [(100 + i, same) for i in range(40)]  # a crowd of equal vectors
    rows += [(200, [0.0] * 4), (300, None), (400, []), (500, [1.0, None, 1.0, 1.0]), (600, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(700, [float("inf"), 1.0, 1.0, 1.0]), (800, [1.0, 1.0]), (900, [2.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(100, same), (1000, same), (1000, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS rank", "1 AS rep", "2 AS v")
    got = lists(nearest_neighbours(df, candidates=10_000).collect())
    want = brute(rows, 10, 100)
    assert got.keys() == {q for q, w in want.items() if w} == {100, 800, 900, 1000}
    for q in got:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12, rtol=0)
    assert [j for _, j in got[800]] == [900]


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 30)]
    same = [1.0, 2.0, 3.0, 4.0]
    rows += [(100, same)] * 50 + [(101, same)] * 25 + [(i, same) for i in range(102, 108)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = lists(nearest_neighbours(df, candidates=10_000).collect())
    want = brute(rows, 10, 100)
    assert [j for _, j in got[100]] == [j for _, j in want[100]]
    assert [j for _, j in got[100]][:7] == list(range(101, 108))


def test_shared_prefix():
    a = np.array([0b1011 << 28, 7, 7], dtype=np.int64)
    b = np.array([0b1001 << 28, 7, 6], dtype=np.int64)
    assert shared_prefix(a, b).tolist() == [2, 32, 31]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_neighbours(df).count() == 0
