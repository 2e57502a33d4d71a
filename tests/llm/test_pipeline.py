from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from .test_exact_dedup import lowered
from .test_packing import expected_pieces
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def check_stages(spark, docs):
    """Each stage against brute force on its own input."""
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = texts(docs) - texts(kept)
    assert not any(any(c.isalpha() for c in t or "") for _, t in gone)  # clean documents stay

    unique = corpus_pipeline.exact_dedup(spark, kept, SF)
    assert unique.columns == docs.columns
    best = {}
    for (i, t), _ in texts(kept).items():
        key = lowered(t)
        best[key] = i if key not in best or best[key] is None else max(best[key], i if i is not None else best[key])
    assert sorted((str(i), lowered(t)) for (i, t) in texts(unique).elements()) == sorted((str(i), k) for k, i in best.items())

    single = corpus_pipeline.near_dedup(spark, unique, SF)
    assert single.columns == docs.columns
    rows = sorted(((i, t) for i, t in texts(unique) if i is not None), key=lambda r: r[0])
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    low = defaultdict(list)
    for (i, _), c in zip(rows, comp, strict=True):
        low[int(c)].append(i)
    assert {r["doc_id"] for r in single.collect() if r["doc_id"] is not None} == {min(v) for v in low.values()}

    mixed = corpus_pipeline.mixing(spark, single, SF)
    assert mixed.columns == docs.columns
    assert set(texts(mixed)) == set(texts(single))

    packed = corpus_pipeline.packing(spark, mixed, SF).collect()
    want = expected_pieces([(r["doc_id"], r["text"]) for r in mixed.collect()], 2048)
    assert Counter(tuple(r)[:5] for r in packed) == want


def test_stages_on_the_table(spark):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_stages_on_edge_rows(spark, edge_docs):
    # One row per id, as the near duplicates take rows of one id as one document.
    docs = edge_docs.select(*COLUMNS).filter("coalesce(doc_id, 0) not in (9, 10)").dropDuplicates(["doc_id"]).persist()
    docs.count()
    check_stages(spark, docs)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID",
        "exact dedup",
        "SimHash near-dedup",
        "mixing sources",
        "best-fit packing",
    ]


def test_empty_table(spark, no_docs):
    docs = no_docs.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
