"""Batch record changes == applying the changes one by one (the services'
sequential semantics), on random change batches."""

from hypothesis import given, settings
from hypothesis import strategies as st

from sliceforge.operators.records import create_chunk_records, update_records, upsert_document_chunks

TS = "2024-01-01 00:00:00"
IDS = ["d-chunk-1", "d-chunk-2", "d-chunk-3"]
KEYS = ["llm_analysis.topic", "llm_entity_extraction.who", "tokens", "status", "note"]


def _sequential(records, changes):
    """Apply changes in seq order per record, like one update call after another."""
    state = {r["id"]: dict(r) for r in records}
    history = []
    for cid, seq, vid, fields in sorted(changes, key=lambda c: (c[0], c[1])):
        rec = state[cid]
        history.append((cid, seq, vid, rec["version_id"]))
        for k, v in fields.items():
            if k.startswith("llm_analysis."):
                rec["llm_analysis"] = {**rec["llm_analysis"], k.split(".", 1)[1]: v}
            elif k.startswith("llm_entity_extraction."):
                rec["llm_entity_extraction"] = {**rec["llm_entity_extraction"], k.split(".", 1)[1]: v}
            elif k == "tokens":
                rec["tokens"] = int(v)
            else:
                rec["attributes"] = {**rec["attributes"], k: v}
        rec["version_id"] = vid
    return state, sorted(history)


change_batches = st.lists(
    st.tuples(
        st.sampled_from(IDS),
        st.dictionaries(st.sampled_from(KEYS), st.integers(0, 99).map(str), min_size=1, max_size=3),
    ),
    min_size=1,
    max_size=8,
)


@settings(max_examples=12, deadline=None)
@given(change_batches)
def test_update_batch_equals_sequential(spark, batch):
    chunks = spark.createDataFrame(
        [(cid, i + 1, 10 + i, "d", f"h{i}", 20) for i, cid in enumerate(IDS)],
        "id string, number int, tokens int, doc_id string, content_hash string, character_count int",
    )
    records = create_chunk_records(chunks, TS)
    seqs, changes = {}, []
    for cid, fields in batch:
        seqs[cid] = seqs.get(cid, 0) + 1
        changes.append((cid, seqs[cid], f"{cid}-v{seqs[cid]}", fields))
    df = spark.createDataFrame(changes, "chunk_id string, seq int, version_id string, fields map<string,string>")
    updated, history, _ = update_records(records, df, TS)

    base = [r.asDict() for r in records.collect()]
    want_state, want_hist = _sequential(base, changes)
    for r in updated.collect():
        w = want_state[r.id]
        assert (r.version_id, r.tokens, r.llm_analysis, r.llm_entity_extraction, r.attributes) == (
            w["version_id"], w["tokens"], w["llm_analysis"], w["llm_entity_extraction"], w["attributes"],
        )
    got_hist = sorted((h.record_id, h.seq, h.version_id, h.parent_version_id) for h in history.collect())
    assert got_hist == want_hist


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["c1", "c2", "c9"]), st.dictionaries(st.sampled_from(["a", "b", "tokens"]), st.integers(0, 9).map(str), min_size=1, max_size=2)), min_size=1, max_size=6))
def test_document_upsert_equals_sequential(spark, batch):
    docs = spark.createDataFrame([("d", "v0")], "id string, version_id string")
    entries = spark.createDataFrame(
        [("d", "c1", {"tokens": "5"}), ("d", "c2", {"a": "x"})], "doc_id string, chunk_id string, fields map<string,string>"
    )
    updates = [("d", i + 1, f"dv{i + 1}", cid, fields) for i, (cid, fields) in enumerate(batch)]
    df = spark.createDataFrame(updates, "doc_id string, seq int, version_id string, chunk_id string, fields map<string,string>")
    merged, _, versions = upsert_document_chunks(docs, entries, df, TS)

    want = {"c1": {"tokens": "5"}, "c2": {"a": "x"}}
    for _, _, _, cid, fields in updates:  # the reference: merge into a found entry, else append
        want[cid] = {**want.get(cid, {}), **fields}
    assert {r.chunk_id: r.fields for r in merged.collect()} == want
    assert versions.first().version_id == f"dv{len(updates)}"
