"""Plan properties that matter for cost: the packer UDF is evaluated once per
plan (never duplicated by a pushed-down filter), the JVM engine has no
Python at all, and scans read only the columns used."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize(
    "name,python_evals",
    [
        ("chunks_greedy_64", 1),
        ("chunks_sentence_8", 1),
        ("document_info_64", 1),
        ("processing_state_64", 1),
        ("processing_runs_64", 1),
        ("chunks_bpe_256", 2),  # the packer, and the recount of its chunks
        ("versions_64", 0),  # needs no chunks: the packer is pruned away
        ("chunks_greedy_catalyst_64", 0),
        ("chunks_sentence_catalyst_8", 0),
    ],
)
def test_packer_evaluated_once(spark, name, python_evals):
    tree = _plan(spark, name).split("\n\n")[0]
    assert len(re.findall(r"ArrowEvalPython", tree)) == python_evals


def test_scans_are_pruned(spark):
    plan = _plan(spark, "chunks_greedy_64")
    assert re.findall(r"ReadSchema: (struct<[^\n]*>)", plan) == ["struct<doc_id:bigint,text:string>"]
