"""The corpus scan lists and reads files in tasks, whatever their names and sizes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sliceforge.config import ChunkOptions
from sliceforge.plans.run import run_import
from sliceforge.sources import corpus as corpus_module
from sliceforge.sources.corpus import scan_corpus
from sliceforge.sources.listing import list_files, read_files


def _folder() -> str:
    return tempfile.mkdtemp(prefix="sliceforge-listing-")


def _put(path: str, body: bytes = b"") -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body)
    return path


def test_hidden_empty_and_odd_names(spark):
    src = _folder()
    bodies = {
        "a.txt": b"One. Two.", ".x.txt": b"hidden.", "_x.txt": b"also.", ".txt": b"only the suffix.", "empty.txt": b"",
        "_sub/.deep/b.txt": b"deep.", "with space %20 #1 \u00e9/c d.txt": "Zo\u00eb.\r\nEnd.".encode(), "UP.TXT": b"no.", "a.txt.bak": b"no.",
    }
    for name, body in bodies.items():
        _put(f"{src}/{name}", body)
    rows = {r.path: r for r in scan_corpus(spark, src).collect()}
    want = {f"file:{src}/{n}": b.decode().replace("\r\n", "\n") for n, b in bodies.items() if n.endswith(".txt")}
    assert {p: r.text for p, r in rows.items()} == want
    assert all(r.filename == p.rsplit("/", 1)[1] and r.decode_error is None for p, r in rows.items())
    one = scan_corpus(spark, f"{src}/_x.txt").collect()
    assert [(r.text, r.doc_id) for r in one] == [("also.", rows[f"file:{src}/_x.txt"].doc_id)]


def test_many_files(spark):
    src = _folder()
    for i in range(100_000):
        if i % 1000 == 0:
            os.makedirs(f"{src}/{i // 10_000}/{i // 1000}")
        prefix = ("", ".", "_")[i % 3]
        with open(f"{src}/{i // 10_000}/{i // 1000}/{prefix}f{i}.txt", "wb") as f:
            f.write(b"" if i % 7 == 0 else b"Text %d." % i)
    rows = scan_corpus(spark, src)
    got = rows.agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("text") == "").alias("empty"),
        F.sum(F.regexp_extract("text", r"(\d+)", 1).try_cast("long")).alias("total"),
    ).first()
    assert tuple(got) == (100_000, 100_000, len(range(0, 100_000, 7)), sum(i for i in range(100_000) if i % 7))


def test_large_trees_take_rounds(spark):
    src = _folder()
    want = {f"file:{_put(f'{src}/{a}/{b}/{c}.txt', b'x')}" for a in range(4) for b in range(5) for c in range(6)}
    os.symlink(src, f"{src}/0/loop")
    for descend in (1, 7, 10_000):
        files = list_files(spark, f"file:{src}", ".txt", descend=descend).collect()
        assert len(files) == len(want) and {f.path for f in files} == want


def test_a_file_that_cannot_be_read_fails_alone(spark, tmp_out, monkeypatch):
    src = _folder()
    _put(f"{src}/a.txt", b"Fine text.")
    gone = f"file:{src}/gone.txt"

    def with_gone(session, folder, suffix):
        extra = session.createDataFrame([(gone, 5), (f"file:{src}/huge.txt", 1 << 33)], "path string, size long")
        return list_files(session, folder, suffix).unionByName(extra)

    monkeypatch.setattr(corpus_module, "list_files", with_gone)
    rows = {r.filename: r for r in scan_corpus(spark, src).collect()}
    assert rows["a.txt"].decode_error is None and rows["gone.txt"].text is None
    assert "can't read" in rows["gone.txt"].decode_error and "larger than a row" in rows["huge.txt"].decode_error
    result = run_import(spark, src, tmp_out, ChunkOptions(factor=1 / 32, run_id="g"))
    assert (result["processed_files"], result["failed_files"]) == (1, 2)


def test_batches_of_large_files(spark):
    src = _folder()
    sizes = [0, 1, 9 << 20, 9 << 20, 3, 0, 17 << 20]
    for i, n in enumerate(sizes):
        _put(f"{src}/{i}.txt", b"a" * n)
    files = list_files(spark, f"file:{src}", ".txt").coalesce(1)
    got = read_files(files, 1).select(F.element_at(F.split("path", "/"), -1).alias("f"), F.length("content").alias("n")).collect()
    assert sorted((r.f, r.n) for r in got) == [(f"{i}.txt", n) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("name", ["note.md", "missing.txt", "missing"])
def test_not_a_corpus(spark, name):
    src = _folder()
    _put(f"{src}/note.md", b"x")
    with pytest.raises(ValueError, match="expected a folder or a file"):
        scan_corpus(spark, f"{src}/{name}")
