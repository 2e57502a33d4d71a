"""Every registered query against its DuckDB SQL at sf0.001 (the driver's gate, small)."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

NAMES = sorted(E.queries())


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in pdf[cols].itertuples(index=False, name=None))
    return cols, len(rows), hashlib.md5("".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "doc_id", "number", "tokens", "content_hash", "character_count"]
    assert df.count() > 0


SPARK_TO_DUCKDB = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = df.toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.sql(sql).df()
    assert _digest(got) == _digest(want)
    spark_types = {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {row[0]: row[1] for row in con.sql(f"DESCRIBE ({sql})").fetchall()}
    assert spark_types == duck_types
