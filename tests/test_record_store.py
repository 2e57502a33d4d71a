"""Stored records: copy-on-write batches, lookups by range, concurrent writers."""

import threading

import pytest
from pyspark.sql import functions as F

from sliceforge.operators.records import RecordError
from sliceforge.plans.changes import apply_changes, apply_upserts, create_chunk_store, create_document_store
from sliceforge.sinks.commit_log import CommitLog
from sliceforge.sinks.record_store import StoreError, lookup_store, merge_store, read_history, read_store, store_files

TS = "2024-01-01 00:00:00"
CHANGES = "action string, id string, seq int, version_id string, fields map<string,string>"


def chunks(spark, n=100):
    return spark.range(n).select(
        F.format_string("d%03d-chunk-1", "id").alias("id"), F.lit(1).alias("number"), F.lit(5).alias("tokens"),
        F.format_string("d%03d", "id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("content_hash"),
        F.lit(20).alias("character_count"),
    )


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGES)


def paths(spark, root, version=None):
    return {f.path for f in store_files(spark, root, version).collect() if f.path}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture()
def root(spark, tmp_out):
    create_chunk_store(chunks(spark), tmp_out, TS, target_rows=10)
    return tmp_out


def test_only_touched_files_are_rewritten(spark, root):
    before = paths(spark, root)
    assert len(before) == 10
    r = apply_changes(
        spark, root,
        batch(
            spark,
            ("update", "d003-chunk-1", 1, "v1", {"tokens": "7", "status": "seen"}),
            ("update", "d003-chunk-1", 2, "v2", {"llm_analysis.topic": "x"}),
            ("delete", "d004-chunk-1", None, None, None),
            ("delete", "nowhere", None, None, None),
        ),
        "2024-01-02 00:00:00",
    )
    after = paths(spark, root)
    assert (r["version"], r["missing"]) == (1, 1)
    assert len(before & after) == 8 and r["touched_files"] == 2  # "nowhere" falls into the last range
    row = read_store(spark, root).where("id = 'd003-chunk-1'").first()
    assert (row.tokens, row.version_id, row.attributes, row.llm_analysis) == (7, "v2", {"status": "seen"}, {"topic": "x"})
    assert read_store(spark, root).count() == 99
    assert read_store(spark, root, 0).count() == 100  # the version before stays readable
    history = {(h.record_id, h.seq, h.parent_version_id) for h in read_history(spark, root).where("action = 'updated'").collect()}
    first = read_store(spark, root, 0).where("id = 'd003-chunk-1'").first().version_id
    assert history == {("d003-chunk-1", 1, first), ("d003-chunk-1", 2, "v1")}


def test_create_then_change_and_an_emptied_range(spark, root):
    apply_changes(spark, root, batch(spark, ("create", "d050-new", None, "c", {"number": "9", "tokens": "3", "doc_id": "d050", "note": "n"}),
                                     ("update", "d050-new", 1, "u", {"tokens": "4"})), TS)
    row = lookup_store(spark, root, ["d050-new"]).first()
    assert (row.number, row.tokens, row.doc_id, row.attributes, row.version_id) == (9, 4, "d050", {"note": "n"}, "u")
    old = [(("delete"), f"d{i:03d}-chunk-1", None, None, None) for i in range(10)]
    apply_changes(spark, root, batch(spark, *old), TS)
    assert read_store(spark, root).count() == 91 and len(paths(spark, root)) == 9
    apply_changes(spark, root, batch(spark, ("create", "a first", None, "c", {}), ("create", "z last", None, "c", {})), TS)
    assert ids(lookup_store(spark, root, ["a first", "z last", "d005-chunk-1"])) == ["a first", "z last"]


def test_a_refused_batch_changes_nothing(spark, root):
    bad = [
        ("create", "d001-chunk-1", None, "v", {}),
        ("update", "missing", 1, "v", {}),
        ("update", "d001-chunk-1", 2, "v", {}),
        ("update", "d001-chunk-1", 1, "v", {"tokens": "many"}),
        ("create", "x", None, "v", {"id": "y"}),
        ("rename", "d001-chunk-1", 1, "v", {}),
    ]
    before = paths(spark, root)
    for change in bad:
        with pytest.raises(RecordError):
            apply_changes(spark, root, batch(spark, change), TS)
    assert paths(spark, root) == before and store_files(spark, root, 0).count() == 10


def test_lookups_open_few_files(spark, root):
    found = lookup_store(spark, root, ["d033-chunk-1", "d034-chunk-1", "gone"])
    assert ids(found) == ["d033-chunk-1", "d034-chunk-1"]
    assert len(found.inputFiles()) == 2  # of ten: one range, and the last for "gone"
    many = lookup_store(spark, root, spark.range(20, 30).select(F.format_string("d%03d-chunk-1", "id").alias("id")))
    assert many.count() == 10 and len(lookup_store(spark, root, ["d000-chunk-1"]).inputFiles()) == 1


def test_a_grown_range_is_spread(spark, root):
    rows = [("create", f"d050-x{i:03d}", None, "c", {"doc_id": "d050"}) for i in range(60)]
    apply_changes(spark, root, batch(spark, *rows), TS)
    files = store_files(spark, root).where("parts > 1").collect()
    assert len(files) == 7 and {f.parts for f in files} == {7}
    found = lookup_store(spark, root, ["d050-x007"])
    assert found.count() == 1 and len(found.inputFiles()) == 1
    assert read_store(spark, root).count() == 160
    r = apply_changes(spark, root, batch(spark, ("delete", "d050-x007", None, None, None)), TS)
    assert r["touched_files"] == 7 and read_store(spark, root).count() == 159


def test_concurrent_writers_lose_nothing(spark, root):
    """Batches on the same and on other ranges, begun together."""
    errors = []

    def write(i):
        try:
            apply_changes(spark, root, batch(spark, ("create", f"d00{i}-new", None, "c", {}), ("update", "d09%d-chunk-1" % i, 1, f"w{i}", {"tokens": str(i)})), TS)
        except Exception as exc:
            errors.append(exc)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = read_store(spark, root)
    assert got.count() == 104
    assert {r.id: r.tokens for r in got.where("version_id like 'w%'").collect()} == {f"d09{i}-chunk-1": i for i in range(4)}
    assert CommitLog(spark, f"{root}/log").versions() == [0, 1, 2, 3, 4]


def test_a_writer_that_was_overtaken_begins_again(spark, root):
    calls = []

    def rewrite(rows):
        if not calls:  # another batch on the same range comes first
            calls.append(1)
            apply_changes(spark, root, batch(spark, ("update", "d003-chunk-1", 1, "other", {"tokens": "50"})), TS)
        else:
            calls.append(2)
        return rows.withColumn("tokens", F.when(F.col("id") == "d003-chunk-1", F.col("tokens") + 1).otherwise(F.col("tokens"))), None

    merge_store(spark, root, spark.createDataFrame([("d003-chunk-1",)], "id string"), rewrite)
    row = read_store(spark, root).where("id = 'd003-chunk-1'").first()
    assert (row.tokens, row.version_id) == (51, "other") and calls == [1, 2]


def test_documents_upserts(spark, tmp_out):
    docs = spark.range(30).select(F.format_string("d%02d", "id").alias("id"), F.lit("v0").alias("version_id"))
    entries = docs.select(F.col("id").alias("doc_id"), F.concat("id", F.lit("-1")).alias("chunk_id"),
                          F.create_map(F.lit("number"), F.lit("1")).alias("fields"))
    create_document_store(docs, entries, tmp_out, target_rows=15)
    schema = "doc_id string, seq int, version_id string, chunk_id string, fields map<string,string>"
    ups = spark.createDataFrame([("d05", 1, "a", "d05-1", {"x": "1"}), ("d05", 2, "b", "d05-2", {"y": "2"})], schema)
    r = apply_upserts(spark, tmp_out, ups, TS)
    assert r["touched_files"] == 1
    apply_upserts(spark, tmp_out, spark.createDataFrame([("d05", 1, "c", "d05-1", {"x": "9"})], schema), TS)
    rows = {(x.chunk_id): (x.version_id, x.fields) for x in lookup_store(spark, tmp_out, ["d05"]).collect()}
    assert rows == {None: ("c", None), "d05-1": (None, {"number": "1", "x": "9"}), "d05-2": (None, {"y": "2"})}
    parents = {h.version_id: h.parent_version_id for h in read_history(spark, tmp_out).collect()}
    assert parents == {"a": "v0", "b": "a", "c": "b"}
    with pytest.raises(RecordError):
        apply_upserts(spark, tmp_out, spark.createDataFrame([("none", 1, "a", "c", {})], schema), TS)
    assert read_store(spark, tmp_out).count() == 61


def test_a_store_is_made_once(spark, root, tmp_out):
    with pytest.raises(StoreError, match="already"):
        create_chunk_store(chunks(spark, 3), root, TS)
    with pytest.raises(StoreError, match="no record store"):
        read_store(spark, f"{tmp_out}/elsewhere")


def test_an_entry_is_put_once(spark, tmp_out):
    logs = [CommitLog(spark, f"{tmp_out}/log") for _ in range(8)]
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(logs[i].append(lambda last: {"by": i}))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    entries = logs[0].entries()
    assert [e["version"] for e in entries] == list(range(8)) and {e["by"] for e in entries} == set(range(8))
    assert not logs[0].put_if_absent(3, {"version": 3}) and "by" in logs[0].read(3)
