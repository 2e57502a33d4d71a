"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query is forced with the ``noop`` sink (every row
computed, nothing collected to the driver).  A small warm-up query runs first
so JVM start-up and the first Python worker launch are not charged to a query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sliceforge.config import ChunkOptions  # noqa: E402
from sliceforge.functions.tokens import get_counter  # noqa: E402
from sliceforge.operators.chunker import chunk_documents  # noqa: E402
from sliceforge.plans import catalog  # noqa: E402
from sliceforge.plans.import_job import INPUT_PARTITIONS  # noqa: E402
from sliceforge.plans.run import run_import, run_verification  # noqa: E402
from sliceforge.session import local_session  # noqa: E402

HEADLINE = [
    "chunks_greedy_64",
    "chunks_greedy_256",
    "chunks_greedy_catalyst_64",
    "chunks_sentence_64",
    "chunks_sentence_8",
    "chunks_lossless_64",
    "chunks_bpe_256",
    "document_info_64",
    "verify_strict_64",
    "manifest_append_64",
    "records_update_256",
    "token_counts",
]

# Throughput per counter and engine (SURVEY / BASELINE ask for these).
THROUGHPUT = {"regex/arrow": "chunks_greedy_64", "regex/catalyst": "chunks_greedy_catalyst_64", "bpe/arrow": "chunks_bpe_256"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="sliceforge-bench")
    # The fixture is one row group, which one task would read alone.
    spark.conf.set(INPUT_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]

    # Warm-up on the small benchmark table: JVM, Python workers and both
    # counters' per-worker state (the BPE vocabulary), loaded once per worker.
    qs["chunks_benchmark_64"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warm = catalog.corpus(spark, sf_dir, "benchmark", "item_id")
    chunk_documents(warm, 256, get_counter("bpe", encoding="byte_bpe_50k", on_special="text")).write.format("noop").mode(
        "overwrite"
    ).save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    # The end-to-end job: import writing every table, then strict verification
    # over the stored tables (a fresh scratch folder per run).
    if not sys.argv[1:]:
        try:
            out = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_TMP", "/tmp"))
            docs_df = spark.read.parquet(f"{sf_dir}/documents.parquet")
            t0 = time.perf_counter()
            run_import(spark, docs_df, out, ChunkOptions(factor=1 / 128, run_id="bench"))
            times["import_job_write"] = round(time.perf_counter() - t0, 3)
            t0 = time.perf_counter()
            run_verification(spark, out, "strict")
            times["verify_job_strict"] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # report, keep the query timings
            times["import_job_error"] = str(exc)[:200]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    throughput = {}
    for label, q in THROUGHPUT.items():
        t = times.get(q)
        if not t:
            continue
        chunks = qs[q](spark, sf_dir).agg(F.count("*"), F.sum("tokens")).first()
        throughput[label] = {
            "query": q,
            "docs_per_s": round(n_docs / t, 1),
            "input_mb_per_s": round(n_bytes / 1e6 / t, 2),
            "chunks_per_s": round(chunks[0] / t, 1),
            "tokens_per_s": round(chunks[1] / t, 1),
        }
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(v for v in times.values() if isinstance(v, float)), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
                "throughput": throughput,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
