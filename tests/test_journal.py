"""The run journal: states, failures, crashes, runs at the same time."""

import threading

import pytest
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.plans import run as run_module
from sliceforge.plans.journal import AbandonedRun, complete_run, read_runs, recover_runs, run_log, start_run
from sliceforge.plans.run import run_import, run_verification
from sliceforge.sources.tables import read_document_info, read_manifest, read_table

from .conftest import SF_SMALL


def items(spark):
    return spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")


def opts(name):
    return ChunkOptions(factor=1 / 128, run_id=name)


def states(spark, out):
    return [(r.run_seq, r.status) for r in read_runs(spark, out).orderBy("version").collect()]


def test_a_failed_run_is_recorded_and_not_seen(spark, tmp_out):
    first = run_import(spark, items(spark), tmp_out, opts("one"))
    broken = items(spark).withColumn("text", F.raise_error(F.lit("the source broke")).cast("string"))
    with pytest.raises(Exception, match="the source broke"):
        run_import(spark, broken, tmp_out, opts("two"))
    assert states(spark, tmp_out) == [(0, "processing"), (0, "completed"), (1, "processing"), (1, "failed")]
    ends = {r.run_seq: r for r in read_runs(spark, tmp_out).where("status != 'processing'").collect()}
    assert ends[0].duration > 0 and ends[1].duration > 0 and ends[0].totals.document_count == first["processed_files"]
    assert "the source broke" in ends[1].error and ends[0].error is None
    header, entries = read_manifest(spark, tmp_out)
    assert header.first().document_count == entries.count() == first["processed_files"]
    third = run_import(spark, items(spark), tmp_out, opts("three"))
    assert third["run_seq"] == 2
    assert read_manifest(spark, tmp_out)[0].first().document_count == 2 * first["processed_files"]


def test_runs_started_together_appear_once_each(spark, tmp_out):
    results, errors = {}, []

    def work(name):
        try:
            results[name] = run_import(spark, items(spark), tmp_out, opts(name))
        except Exception as exc:
            errors.append(exc)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b", "c")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(r["run_seq"] for r in results.values()) == [0, 1, 2]
    assert len({r["manifest_id"] for r in results.values()}) == 1
    h, entries = read_manifest(spark, tmp_out)
    h = h.first()
    assert h.document_count == entries.count() == sum(r["processed_files"] for r in results.values())
    assert (h.total_chunks, h.total_tokens) == (sum(r["chunks"] for r in results.values()), sum(r["tokens"] for r in results.values()))
    ids = read_document_info(spark, tmp_out).select("id")
    assert ids.count() == ids.distinct().count() == h.document_count
    assert run_verification(spark, tmp_out, "strict")["invalid"] == 0


class Killed(BaseException):
    """The driver dies: no handler runs."""


def test_a_crash_before_the_commit_leaves_nothing_visible(spark, tmp_out, monkeypatch):
    def die(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(run_module, "complete_run", die)
        with pytest.raises(Killed):
            run_import(spark, items(spark), tmp_out, opts("dead"))
    assert spark.read.parquet(f"{tmp_out}/chunks").count() > 0  # the data is there
    assert read_manifest(spark, tmp_out) == (None, None)
    assert read_table(spark, tmp_out, "chunks").count() == 0 and read_document_info(spark, tmp_out).count() == 0
    # A later start leaves a run alone that may still be at work, and records an old one.
    second = run_import(spark, items(spark), tmp_out, opts("next"))
    assert states(spark, tmp_out)[:1] == [(0, "processing")] and (0, "failed") not in states(spark, tmp_out)
    run_import(spark, items(spark), tmp_out, opts("last"), abandon_after_s=0)
    assert (0, "failed") in states(spark, tmp_out)
    assert read_manifest(spark, tmp_out)[0].first().document_count == 2 * second["processed_files"]


def test_a_run_recorded_as_abandoned_cannot_complete(spark, tmp_out):
    log = run_log(spark, tmp_out)
    run = start_run(log, opts("slow"), "m")
    assert recover_runs(log, 0) == [0] and recover_runs(log, 0) == []
    totals = {"document_count": 1, "total_chunks": 1, "total_tokens": 1, "latest_version_id": "v", "content_hashes_xor": "0" * 32}
    with pytest.raises(AbandonedRun):
        complete_run(log, 0, run["attempt"], totals, "2024-01-01 00:00:00")
    assert [e["status"] for e in log.entries()] == ["processing", "failed"]


def test_an_epoch_written_again_counts_once(spark, tmp_out):
    log = run_log(spark, tmp_out)
    totals = {"document_count": 3, "total_chunks": 5, "total_tokens": 7, "latest_version_id": "v", "content_hashes_xor": "0" * 31 + "3"}
    for seq, t in ((4, totals), (5, totals), (4, {**totals, "document_count": 10, "content_hashes_xor": "0" * 31 + "5"})):
        run = start_run(log, opts("s"), "m", run_seq=seq)
        complete_run(log, seq, run["attempt"], t, "2024-01-01 00:00:00")
    h = read_manifest_header(log)
    assert (h["document_count"], h["total_chunks"], h["content_hashes_xor"][-1]) == (13, 10, "6")
    assert log.last()["next_run_seq"] == 6 and log.last()["hidden"] == []


def read_manifest_header(log):
    return log.last()["header"]
