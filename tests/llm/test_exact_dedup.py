import hashlib
import random
from collections import Counter, defaultdict

from sliceforge.llm.exact_dedup import CUT, MAX_CHARS, content_chunks, drop_exact_duplicates, exact_dedup

from .conftest import edge_rows


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_equals_brute_force_on_edge_rows(edge_docs):
    got = Counter(tuple(r) for r in exact_dedup(edge_docs).collect())
    groups = defaultdict(list)
    for i, t, *_ in edge_rows():
        groups[lowered(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            want[(i, keep, len(ids), kept, sha)] += 1
    assert got == want


def test_every_group_keeps_one_row_with_all_columns(edge_docs):
    kept = drop_exact_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = Counter(lowered(r["text"]) for r in kept.collect())
    assert set(texts) == {lowered(t) for _, t, *_ in edge_rows()}
    assert set(texts.values()) == {1}


def test_chunks_rebuild_the_text_and_follow_content(spark):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefghilmnoprst") for _ in range(rnd.randint(2, 9))) for _ in range(9000))
    rows = [(text,), ("inserted at the front, " * 3 + text,), ("",), ("x" * 10_000,)]
    df = spark.createDataFrame(rows, "t string")
    found = [r["c"] for r in df.select(content_chunks(df["t"]).alias("c")).collect()]
    for (t,), chunks in zip(rows, found, strict=True):
        assert "".join(chunks) == t
        assert all(len(c) <= MAX_CHARS + 3 for c in chunks), CUT
    assert len(set(found[0]) & set(found[1])) > len(found[0]) * 0.9  # boundaries come back after an insertion


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert drop_exact_duplicates(no_docs).count() == 0
