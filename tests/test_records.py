"""Record services as batch operators (V2-V5)."""

import pytest

from sliceforge.operators.records import (
    RecordError,
    create_chunk_records,
    delete_records,
    get_records,
    insert_records,
    update_records,
    upsert_document_chunks,
)

TS = "2024-01-01 00:00:00"


def _records(spark):
    chunks = spark.createDataFrame(
        [("d-chunk-1", 1, 5, "d", "h1", 10), ("d-chunk-2", 2, 6, "d", "h2", 12)],
        "id string, number int, tokens int, doc_id string, content_hash string, character_count int",
    )
    return create_chunk_records(chunks, TS)


def _changes(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, seq int, version_id string, fields map<string,string>")


def test_create_rejects_existing(spark):
    recs = _records(spark)
    with pytest.raises(RecordError):
        insert_records(recs, recs.limit(1))
    assert insert_records(recs.limit(1), recs.where("number = 2")).count() == 2


def test_update_chain_and_fields(spark):
    recs = _records(spark)
    ch = _changes(
        spark,
        [
            ("d-chunk-1", 1, "v1", {"llm_analysis.topic": "a", "status": "x"}),
            ("d-chunk-1", 2, "v2", {"llm_analysis.topic": "b", "tokens": "9"}),
        ],
    )
    upd, hist, unmatched = update_records(recs, ch, TS)
    r = {x.id: x for x in upd.collect()}["d-chunk-1"]
    assert r.version_id == "v2" and r.tokens == 9 and r.llm_analysis == {"topic": "b"} and r.attributes == {"status": "x"}
    h = sorted((x.seq, x.version_id, x.parent_version_id, x.action) for x in hist.collect())
    base = recs.where("id = 'd-chunk-1'").first().version_id
    assert h == [(1, "v1", base, "updated"), (2, "v2", "v1", "updated")]
    assert unmatched.count() == 0


def test_update_errors(spark):
    recs = _records(spark)
    with pytest.raises(RecordError, match="do not exist"):
        update_records(recs, _changes(spark, [("nope", 1, "v", {"a": "b"})]), TS)
    with pytest.raises(RecordError, match="seq"):
        update_records(recs, _changes(spark, [("d-chunk-1", 2, "v", {"a": "b"})]), TS)
    with pytest.raises(RecordError, match="version_id"):
        update_records(recs, _changes(spark, [("d-chunk-1", 1, "v", {"version_id": "x"})]), TS)


def test_delete_and_lookup(spark):
    recs = _records(spark)
    ids = spark.createDataFrame([("d-chunk-2",), ("ghost",)], "id string")
    kept, missing = delete_records(recs, ids)
    assert [r.id for r in kept.collect()] == ["d-chunk-1"]
    assert [r.id for r in missing.collect()] == ["ghost"]
    assert get_records(recs, ["d-chunk-2", "ghost"]).count() == 1


def test_document_upsert(spark):
    docs = spark.createDataFrame([("d", "v0")], "id string, version_id string")
    entries = spark.createDataFrame([("d", "d-chunk-1", {"tokens": "5"})], "doc_id string, chunk_id string, fields map<string,string>")
    updates = spark.createDataFrame(
        [("d", 1, "dv1", "d-chunk-1", {"tokens": "7", "x": "1"}), ("d", 2, "dv2", "d-chunk-9", {"tokens": "1"})],
        "doc_id string, seq int, version_id string, chunk_id string, fields map<string,string>",
    )
    merged, hist, versions = upsert_document_chunks(docs, entries, updates, TS)
    m = {r.chunk_id: r.fields for r in merged.collect()}
    assert m == {"d-chunk-1": {"tokens": "7", "x": "1"}, "d-chunk-9": {"tokens": "1"}}
    assert versions.first().version_id == "dv2"
    assert sorted((r.seq, r.parent_version_id) for r in hist.collect()) == [(1, "v0"), (2, "dv1")]


def test_latest_version(spark):
    from sliceforge.operators.records import latest_version

    hist = spark.createDataFrame(
        [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("b", 0, "b0")], "record_id string, seq int, version_id string"
    )
    assert {r.record_id: r.version_id for r in latest_version(hist).collect()} == {"a": "a2", "b": "b0"}


def _rec(spark, ids=("a", "b")):
    from sliceforge.operators.records import create_chunk_records

    rows = [(i, 1, 5, "d", "h" + i, 9) for i in ids]
    chunks = spark.createDataFrame(rows, "id string, number int, tokens int, doc_id string, content_hash string, character_count int")
    return create_chunk_records(chunks, "2024-01-01 00:00:00")


def _changes(spark, rows):
    return spark.createDataFrame(rows, "record_id string, seq int, version_id string, fields map<string,string>")


def test_insert_refuses_ids_twice_in_the_batch(spark):
    import pytest

    from sliceforge.operators.records import RecordError, insert_records

    with pytest.raises(RecordError, match="already exist: c"):
        insert_records(_rec(spark), _rec(spark, ("c", "c", "d")))
    with pytest.raises(RecordError, match="already exist: a"):
        insert_records(_rec(spark), _rec(spark, ("a",)))
    assert insert_records(_rec(spark), _rec(spark, ("c",))).count() == 3


def test_whole_fields_are_overwritten_in_order(spark):
    from sliceforge.operators.records import update_records

    changes = _changes(
        spark,
        [
            ("a", 1, "v1", {"llm_analysis.topic": "t", "llm_analysis.old": "o", "tokens": "7", "created_at": "2025-05-05 00:00:00"}),
            ("a", 2, "v2", {"llm_analysis": '{"x":"1"}', "character_count": None, "note": "n"}),
            ("a", 3, "v3", {"llm_analysis.y": "2", "note": None, "parent_version_id": "p"}),
            ("b", 1, "w1", {"llm_entity_extraction": None}),
        ],
    )
    got = {r.id: r for r in update_records(_rec(spark), changes, "2024-01-02 00:00:00")[0].collect()}
    a = got["a"]
    assert (a.llm_analysis, a.tokens, a.character_count) == ({"x": "1", "y": "2"}, 7, None)
    assert (a.attributes, a.version_id, a.parent_version_id) == ({"note": None}, "v3", "p")
    assert str(a.created_at).startswith("2025-05-05")
    assert got["b"].llm_entity_extraction is None and got["b"].tokens == 5


def test_bad_batches_are_refused(spark):
    import pytest

    from sliceforge.operators.records import RecordError, update_records

    for fields, message in (
        ({"tokens": "many"}, "do not fit"),
        ({"llm_analysis": "no json"}, "do not fit"),
        ({"version_id": "x"}, "may not set"),
        ({"id": "x"}, "may not set"),
    ):
        with pytest.raises(RecordError, match=message):
            update_records(_rec(spark), _changes(spark, [("a", 1, "v", fields)]), "2024-01-02 00:00:00")


def test_a_record_with_a_third_of_all_changes(spark):
    from sliceforge.operators.records import update_records

    n = 3000
    hot = [("a", i, f"a{i}", {"tokens": str(i), f"k{i % 5}": str(i)}) for i in range(1, n + 1)]
    ids = [f"r{i}" for i in range(2 * n)]
    cold = [(i, 1, f"v-{i}", {"note": i}) for i in ids]
    updated, history, _ = update_records(_rec(spark, ["a", *ids]), _changes(spark, hot + cold), "2024-01-02 00:00:00")
    a = updated.where("id = 'a'").first()
    assert (a.tokens, a.version_id) == (n, f"a{n}")
    assert a.attributes == {f"k{i % 5}": str(i) for i in range(n - 4, n + 1)}
    parents = {r.seq: r.parent_version_id for r in history.where("record_id = 'a'").collect()}
    assert all(parents[i] == f"a{i - 1}" for i in range(2, n + 1)) and history.count() == 3 * n


def test_upsert_into_a_missing_document(spark):
    import pytest

    from sliceforge.operators.records import RecordError, upsert_document_chunks

    docs = spark.createDataFrame([("d", "v0")], "id string, version_id string")
    entries = spark.createDataFrame([], "doc_id string, chunk_id string, fields map<string,string>")
    updates = spark.createDataFrame([("nope", 1, "v1", "c", {"a": "1"})], "doc_id string, seq int, version_id string, chunk_id string, fields map<string,string>")
    with pytest.raises(RecordError, match="not found: nope"):
        upsert_document_chunks(docs, entries, updates, "2024-01-02 00:00:00")
