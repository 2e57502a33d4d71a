"""Verification == the per-document loop (chunks in order, first failure wins),
on random stores: missing chunks, changed texts, extra tokens, wrong totals."""

import hashlib

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sliceforge.functions.tokens import TOKEN_PATTERN_PY
from sliceforge.operators.verify import verify_all_modes

PAT = regex.compile(TOKEN_PATTERN_PY)


def count(t):
    return len(PAT.findall(t))


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def loop_verify(doc, stored, mode):
    total = 0
    for c in sorted(doc["chunks"], key=lambda c: c["number"]):
        text = stored.get(c["id"])
        if text is None:
            return "missing"
        if mode == "lenient":
            continue
        n = count(text)
        if mode == "strict":
            if n != c["tokens"]:
                return "token mismatch"
            if md5(text) != c["content_hash"]:
                return "hash mismatch"
        total += n
    if mode != "lenient" and total != doc["total_tokens"]:
        return "total mismatch"
    return None


CHANGES = st.sampled_from(["keep", "keep", "drop", "reletter", "extra"])
DOC = st.tuples(st.lists(CHANGES, min_size=1, max_size=4), st.sampled_from([0, 0, 0, 1, -2]))


@settings(max_examples=15, deadline=None)
@given(st.lists(DOC, min_size=1, max_size=5))
def test_verify_equals_loop(spark, docs):
    info_rows, stored_rows, model_docs, stored = [], [], [], {}
    for d, (changes, total_offset) in enumerate(docs):
        doc_id = f"doc{d}"
        chunks = []
        for i, change in enumerate(changes, start=1):
            text = f"Chunk {i} of {doc_id}, words here."
            cid = f"{doc_id}-chunk-{i}"
            chunks.append({"id": cid, "number": i, "tokens": count(text), "content_hash": md5(text)})
            if change == "drop":
                continue
            new = {"keep": text, "reletter": "Q" + text[1:], "extra": text + " extra"}[change]
            stored[cid] = new
            stored_rows.append((cid, doc_id, new))
        total = sum(c["tokens"] for c in chunks) + total_offset
        model_docs.append({"id": doc_id, "total_tokens": total, "chunks": chunks})
        info_rows.append((doc_id, total, [(c["id"], c["number"], c["tokens"], doc_id, c["content_hash"], 0, None) for c in chunks]))
    info = spark.createDataFrame(
        info_rows,
        "id string, total_tokens int, chunks array<struct<id:string,number:int,tokens:int,doc_id:string,"
        "content_hash:string,character_count:int,created_at:timestamp>>",
    )
    store = spark.createDataFrame(stored_rows or [("x", "x", "x")], "id string, doc_id string, text string")
    got = {r.doc_id: r for r in verify_all_modes(info, store).collect()}
    for doc in model_docs:
        r = got[doc["id"]]
        assert (r.reason_strict, r.reason_lenient, r.reason_token) == tuple(
            loop_verify(doc, stored, m) for m in ("strict", "lenient", "token")
        ), doc
