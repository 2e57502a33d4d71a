import re

import numpy as np
import pytest
import xxhash

from sliceforge.llm import simhash
from sliceforge.llm.simhash import QUADS, drop_near_duplicates, fingerprint, list_links, refined, simhash_groups

from .conftest import edge_rows


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def labels(n, left, right):
    out = np.arange(n)
    while True:
        low = out.copy()
        np.minimum.at(low, left, out[right])
        np.minimum.at(low, right, out[left])
        low = low[low]
        if (low == out).all():
            return out
        out = low


def brute_components(fps):
    u = np.array(fps, dtype=np.uint64)
    return labels(len(u), *np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4))


def test_groups_on_edge_rows(edge_docs):
    rows = edge_rows()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = brute_components(fps)
    want = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [r[0] for r, c in zip(rows, comp, strict=True) if c == comp[i] and r[0] is not None]
        want.append((str(doc_id), format(fps[i], "016x"), str(min(ids, default=None))))
    got = [(str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash_groups(edge_docs).collect()]
    assert sorted(got) == sorted(want)


def test_near_copies_link(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 5000, 4000)]
    rows = [(i, " ".join(words[: 2000 + i])) for i in range(12)] + [(100, " ".join(words[2000:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [rows[c][0] for c in brute_components([brute_fingerprint(t) for _, t in rows])]
    got = {r["doc_id"]: r["component_id"] for r in simhash_groups(df).collect()}
    assert [got[i] for i, _ in rows] == want
    kept = {r["doc_id"] for r in drop_near_duplicates(df).collect()}
    assert kept == set(want)


def test_long_lists_are_refined_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "LIST_SIZE", 12)
    rng = np.random.default_rng(0)
    found = set()
    for base in rng.integers(0, 2**63, 8, dtype=np.uint64).tolist():
        for _ in range(220):  # crowds that share most bytes
            x = base
            for b in rng.choice(24, rng.integers(0, 9), replace=False):
                x ^= 1 << int(b) * 2
            found.add(x)
    fps = np.array(sorted(found), dtype=np.uint64)
    key = np.concatenate([np.full(len(fps), q, dtype=np.int64) for q in range(len(QUADS))])
    fp = np.tile(fps.view(np.int64), len(QUADS))
    for quad in range(len(QUADS)):
        part = slice(quad * len(fps), (quad + 1) * len(fps))
        for i in QUADS[quad]:
            key[part] = key[part] << 8 | (fps >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)
    left, right, levels = [], [], 0
    for level in range(simhash.LEVELS + 1):
        both = np.unique(np.stack([key, fp]), axis=1)
        key, fp = np.ascontiguousarray(both[0]), np.ascontiguousarray(both[1])
        a, b, over_key, over_fp = list_links(key, fp, level, 4)
        left.append(a)
        right.append(b)
        if not len(over_key):
            break
        levels += 1
        key, fp = refined(over_key, over_fp, level + 1)
    assert levels >= 2
    ends = [np.searchsorted(fps, np.concatenate(x).view(np.uint64)) for x in (left, right)]
    assert (labels(len(fps), *ends) == brute_components(fps)).all()


def test_bounds_and_empty_table(no_docs):
    assert fingerprint("") == 0 == fingerprint(" \n")
    assert simhash_groups(no_docs).count() == 0
    assert drop_near_duplicates(no_docs).count() == 0
    with pytest.raises(ValueError, match="4 differing bits"):
        simhash_groups(no_docs, max_bits=5)
