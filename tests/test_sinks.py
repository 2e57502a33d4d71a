"""JSON / text export and JSON record readers (K7, S7-S9 error handling)."""

import glob
import os

import pytest

from sliceforge.config import ChunkOptions
from sliceforge.plans.import_job import chunks_table, document_info_table, prepare
from sliceforge.sinks.writers import export_chunk_texts, export_json
from sliceforge.sources.corpus import corpus_from_table
from sliceforge.sources.tables import read_json_records

from .conftest import SF_SMALL


def _tables(spark):
    opts = ChunkOptions(factor=1 / 32, run_ts="2024-01-01 12:00:00")
    prepared = prepare(corpus_from_table(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").withColumnRenamed("item_id", "doc_id")), opts)
    return document_info_table(prepared, opts, "m"), chunks_table(prepared, opts)


def test_json_round_trip_and_malformed(spark, tmp_out):
    info, _ = _tables(spark)
    path = os.path.join(tmp_out, "document_info_json")
    export_json(info, path)
    text = open(glob.glob(f"{path}/part-*.json")[0]).readline()
    assert '"processed_at":"2024-01-01T12:00:00' in text
    with open(os.path.join(path, "part-zz-broken.json"), "w") as fh:
        fh.write('{"id": "x", "filename": \n')
    back = read_json_records(spark, path, info.schema, mode="PERMISSIVE")
    rows = back.select("id", "_corrupt_record").collect()  # Spark refuses queries on the corrupt column alone
    assert sum(r._corrupt_record is None for r in rows) == info.count()
    assert sum(r._corrupt_record is not None for r in rows) == 1
    with pytest.raises(Exception):
        read_json_records(spark, path, info.schema, mode="FAILFAST").count()


def test_text_export(spark, tmp_out):
    _, chunks = _tables(spark)
    path = os.path.join(tmp_out, "texts")
    export_chunk_texts(chunks, path)
    assert spark.read.text(path).count() >= chunks.count()


def test_pretty_json(spark, tmp_out):
    import json

    info, _ = _tables(spark)
    path = os.path.join(tmp_out, "pretty")
    export_json(info.limit(1), path, pretty=True)
    body = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    rec = json.loads(body)
    assert rec["model_name"] == "gpt-4" and body.count("\n") > 5 and rec["processed_at"].startswith("2024-01-01T12:00:00")
