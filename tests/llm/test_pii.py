import hashlib
import random
import re
import time

import numpy as np

from sliceforge.llm.pii import (
    KINDS,
    LABELERS,
    decide,
    estimate_reliabilities,
    find_personal_data,
    find_spans,
    islands,
    pattern_features,
    span_digests,
    train_span_classifier,
)

from .conftest import edge_rows

PIECES = ["192.168.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "a.b@c.de", "256.1.1.1", "1.2.3.4.5.6.7.8", "12", "\n", "é"]


def brute(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        n = rnd.randint(1, 40)
        t = "".join(rnd.choice("0123456789+.- ()@ab%") if rnd.random() < 0.8 else rnd.choice(PIECES) for _ in range(n))
        base, candidates = find_spans(t)
        assert base == brute(t), t
        assert {s for s in base} <= {c[:3] for c in candidates}


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_digests_on_edge_rows(edge_docs):
    want = []
    for i, t, *_ in edge_rows():
        base = brute(t or "")
        n = [sum(k == kind for k, *_ in base) for kind in range(4)]
        want.append((str(i), *n, hashlib.sha256(joined(base).encode()).hexdigest()))
    rows = span_digests(find_personal_data(edge_docs)).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in rows) == sorted(want)


def test_counts_are_those_of_their_kind(spark):
    texts = [
        "mail a.b@c.de and x@y.org or z@q.net",
        "hosts 10.0.0.1, 192.168.1.1 and 300.1.1.1",
        "card 4111 1111 1111 1111, call +1 (555) 123-4567 or +49 170 1234567",
        "a.b@c.de, 10.0.0.1, 4111-1111-1111-1111, +1 (555) 123-4567",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in span_digests(find_personal_data(df)).collect()}
    assert got == {0: (3, 0, 0, 0), 1: (0, 2, 0, 0), 2: (0, 0, 1, 2), 3: (1, 1, 1, 1), 4: (0, 0, 0, 0)}


def test_added_spans(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        name = f"user{i}"
        rows.append((i, f"Write mail to {name}@site{i % 9}.com or call +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} now"))
    rows += [(1000 + i, f"please mail john{i} (at) example (dot) com soon") for i in range(60)]
    rows += [(2000 + i, f"order 5{rnd.randint(10**14, 10**15 - 1)} and version {i}.300.1.999 shipped") for i in range(60)]
    rows += [(3000 + i, "nothing personal in these 12 words or 3.14, 1999 - 2024") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in span_digests(find_personal_data(df)).collect()}
    for i, t in rows:
        base = brute(t)
        assert joined(base) == ",".join(s for s in got[i]["spans"].split(",") if s in joined(base).split(",")) or got[i]["n_added"]
        if 1000 <= i < 2000:
            a = t.index("john")
            assert got[i]["spans"] == f"email:{a}:{t.index(' soon')}"
        elif i >= 2000:
            assert got[i]["spans"] == joined(base)


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.4
    good = (0.95, 0.9, 0.8, 0.6, 0.9)  # how often each labeler is right
    votes = np.stack([np.where(rng.random(len(y)) < g, y, ~y) for g in good], axis=1)
    patterns, counts = np.unique(["2" + "".join("-+"[int(v)] for v in row) + "0" for row in votes], return_counts=True)
    prior, table, post = estimate_reliabilities(list(patterns), counts.astype(float))
    assert abs(prior - 0.4) < 0.03
    for j in range(len(LABELERS)):
        assert abs(table[1, j, 2] - good[j]) < 0.04
    w = train_span_classifier(list(patterns), counts, post)
    p = 1 / (1 + np.exp(-pattern_features(list(patterns)) @ w))
    assert ((p > 0.5) == (post > 0.5)).mean() > 0.9


def test_no_pattern_is_accepted_against_a_vote():
    assert not any("-" in p[1:-1] for p in decide({"2+-+000": 500, "20-+000": 100, "2+++000": 900}))


def test_empty_table(no_docs):
    assert span_digests(find_personal_data(no_docs)).count() == 0


def test_long_runs_are_read_once():
    base, _ = find_spans("a" * 200_000 + " 1" * 50_000 + "1." * 50_000 + "+1" + " " * 50_000 + "9" * 50_000)
    assert [k for k, *_ in base].count(0) == 0


def test_islands_equal_the_rule_tried_at_every_place():
    rule = re.compile(r"\+?[0-9(][\x20().0-9-]*[0-9]")
    rnd = random.Random(7)
    for _ in range(20_000):
        text = "".join(rnd.choice("19 ()+.-a+") for _ in range(rnd.randint(0, 24)))
        assert islands(text) == [m.span() for m in rule.finditer(text)], text


def test_megabytes_of_brackets():
    for unit in ("(", "( ", "1(", "+(", "(.", "1 "):
        start = time.perf_counter()
        find_spans(unit * (4_000_000 // len(unit)))
        assert time.perf_counter() - start < 20, unit
