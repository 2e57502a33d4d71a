"""The journal of an output folder's runs.

Every run writes ahead that it is ``processing``, which gives it its ``run_seq``,
and in the end that it is ``completed`` or ``failed`` (with error and duration).
Entries are commits of one log, so runs may be started together: each takes the
next number, writes partitions of its own, and appears with its completing entry,
which also carries the manifest's totals over all completed runs.  A run that
dies in between leaves partitions that no reader sees; the next start records it
as failed once it is older than ``abandon_after_s``, and should it still be alive
it can no longer complete.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceforge.sinks.commit_log import CommitLog

#: Totals of a manifest that add up over runs.
SUMS = ("document_count", "total_chunks", "total_tokens")
RUNS_SCHEMA = (
    "version long, run_seq int, attempt int, run_id string, status string, started_at double, completed_at double, "
    "duration double, error string, totals struct<document_count:long,total_chunks:long,total_tokens:long>"
)
DAY = 86400.0


class AbandonedRun(RuntimeError):
    pass


def run_log(spark: SparkSession, output_dir: str) -> CommitLog:
    return CommitLog(spark, f"{output_dir.rstrip('/')}/run_log")


def _carry(last: dict | None, opts, manifest_id: str) -> dict:
    """What an entry takes over from the last: the manifest, its totals, the next
    free number, the runs at work and the partitions that readers leave out."""
    if last is None:
        header = {"manifest_id": manifest_id, "created_at": opts.run_ts, "model_name": opts.model_name, "updated_at": None,
                  "latest_version_id": None, "content_hashes_xor": "0" * 32, "run_seq": None, **dict.fromkeys(SUMS, 0)}
        return {"header": header, "next_run_seq": 0, "active": {}, "hidden": []}
    return {k: last[k] for k in ("header", "next_run_seq", "active", "hidden")}


def _without(state: dict, run_seq: int) -> dict:
    return {**state, "active": {k: v for k, v in state["active"].items() if k != str(run_seq)},
            "hidden": [h for h in state["hidden"] if h != run_seq]}


def start_run(log: CommitLog, opts, manifest_id: str, run_seq: int | None = None, abandon_after_s: float = DAY) -> dict:
    """Writes ahead ``processing`` and returns that entry.  ``run_seq`` asks for a
    number (a stream's epoch, which is written again after a failure)."""
    recover_runs(log, abandon_after_s)

    def make(last: dict | None) -> dict:
        state = _carry(last, opts, manifest_id)
        seq = state["next_run_seq"] if run_seq is None else run_seq
        before = state["active"].get(str(seq))
        now = time.time()
        state = _without(state, seq)
        attempt = 1 if before is None else before["attempt"] + 1
        active = {"run_id": opts.run_id, "started_at": now, "attempt": attempt}
        return {
            **state,
            "next_run_seq": max(state["next_run_seq"], seq + 1),
            "active": {**state["active"], str(seq): active},
            "hidden": [*state["hidden"], seq],
            "run_seq": seq,
            "status": "processing",
            **active,
        }

    return log.append(make)


def _finish(log: CommitLog, run_seq: int, attempt: int, status: str, **fields) -> dict:
    def make(last: dict) -> dict:
        at_work = last["active"].get(str(run_seq))
        if at_work is None or at_work["attempt"] != attempt:
            raise AbandonedRun(f"run {run_seq} was recorded as failed, or begun again, before it ended")
        now = time.time()
        state = _without(_carry(last, None, ""), run_seq)
        entry = {**state, **at_work, "run_seq": run_seq, "status": status, "completed_at": now,
                 "duration": now - at_work["started_at"], **fields}
        if status == "failed":
            entry["hidden"] = [*state["hidden"], run_seq]
        else:
            entry["header"] = _advance(log, state["header"], run_seq, fields["totals"], fields["updated_at"])
        return entry

    return log.append(make)


def _advance(log: CommitLog, header: dict, run_seq: int, totals: dict, updated_at: str) -> dict:
    """The manifest's totals with those of a run; a run that had completed before
    (an epoch written again) is taken out first."""
    header = dict(header)
    if header["run_seq"] is not None and header["run_seq"] >= run_seq:
        for old in reversed(log.entries()):
            if old["run_seq"] == run_seq and old["status"] == "completed":
                header.update({k: header[k] - old["totals"][k] for k in SUMS})
                header["content_hashes_xor"] = _xor(header["content_hashes_xor"], old["totals"]["content_hashes_xor"])
                break
    header.update({k: header[k] + totals[k] for k in SUMS})
    header["content_hashes_xor"] = _xor(header["content_hashes_xor"], totals["content_hashes_xor"])
    header["updated_at"] = updated_at
    header["run_seq"] = run_seq if header["run_seq"] is None else max(header["run_seq"], run_seq)
    header["latest_version_id"] = totals["latest_version_id"] or header["latest_version_id"]
    return header


def _xor(a: str, b: str) -> str:
    return f"{int(a, 16) ^ int(b, 16):032x}"


def complete_run(log: CommitLog, run_seq: int, attempt: int, totals: dict, updated_at: str) -> dict:
    """The commit: from here on readers see the run."""
    return _finish(log, run_seq, attempt, "completed", totals=totals, updated_at=updated_at)


def fail_run(log: CommitLog, run_seq: int, attempt: int, error: str) -> dict:
    return _finish(log, run_seq, attempt, "failed", error=error)


def recover_runs(log: CommitLog, abandon_after_s: float = DAY) -> list[int]:
    """Records runs that began longer ago than that, and never ended, as failed."""
    recovered = []
    last = log.last()
    old = {} if last is None else {k: v for k, v in last["active"].items() if time.time() - v["started_at"] >= abandon_after_s}
    for seq, run in sorted(old.items(), key=lambda kv: int(kv[0])):
        try:
            fail_run(log, int(seq), run["attempt"], "abandoned: no end was recorded")
            recovered.append(int(seq))
        except AbandonedRun:  # it has ended meanwhile, or somebody else recorded it
            continue
    return recovered


def read_runs(spark: SparkSession, output_dir: str) -> DataFrame:
    """All transitions of all runs, as a table: a run's state is its last version."""
    return run_log(spark, output_dir).table(RUNS_SCHEMA)


def visible(spark: SparkSession, output_dir: str) -> Column | None:
    """The condition on ``run_seq`` that leaves out runs that have not completed
    (None: the folder has no journal)."""
    last = run_log(spark, output_dir).last()
    if last is None:
        return None
    seq = F.col("run_seq")
    shown = seq < last["next_run_seq"]
    return shown & ~seq.isin(last["hidden"]) if last["hidden"] else shown
