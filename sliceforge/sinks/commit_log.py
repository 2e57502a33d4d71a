"""A log of numbered commit files, written put-if-absent.

Entry ``n`` is the file ``<n>.json``.  Writers read the last entry, make the next
from it and put it only if nobody else has; who loses reads again and tries anew.
So entries are totally ordered, and each is whole or not there.  What a commit
refers to is written before it and seen by readers only through it.

The put is a hard link to a finished file where the folder is local, and
elsewhere Hadoop's rename without overwrite, which HDFS does atomically (an
object store needs a file system with an atomic rename or conditional put).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    """The log in ``folder``; entries are JSON objects with their ``version``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = self._path.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the entries, ascending."""
        if not self._fs.exists(self._path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._child(f"{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        versions = self.versions()
        return self.read(versions[-1]) if versions else None

    def entries(self) -> list[dict]:
        return [self.read(v) for v in self.versions()]

    def table(self, schema: str) -> DataFrame:
        """The entries as a table (read by Spark, not by the driver)."""
        return self.spark.read.schema(schema).json(f"{self.folder}/[0-9]*.json")

    def append(self, make: Callable[[dict | None], dict | None]) -> dict | None:
        """Appends ``make(last entry)``; called again whenever another writer was
        first.  ``None`` appends nothing."""
        while True:
            last = self.last()
            entry = make(last)
            if entry is None:
                return None
            entry = {"version": 0 if last is None else last["version"] + 1, **entry}
            if self.put_if_absent(entry["version"], entry):
                return entry

    def put_if_absent(self, version: int, entry: dict) -> bool:
        """Whether this call wrote entry ``version``."""
        self._fs.mkdirs(self._path)
        temp, target = self._child(f".{uuid.uuid4().hex}.tmp"), self._child(f"{version:020d}.json")
        out = self._fs.create(temp, False)
        try:
            out.write(json.dumps(entry, sort_keys=True).encode("utf-8"))
        finally:
            out.close()
        try:
            return self._move(temp, target)
        finally:
            if self._fs.exists(temp):
                self._fs.delete(temp, False)

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def _move(self, temp, target) -> bool:
        from py4j.protocol import Py4JJavaError

        real = self._fs.resolvePath(temp)
        try:
            if real.toUri().getScheme() == "file":
                files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
                source = paths.get(real.toUri())
                files.createLink(source.resolveSibling(target.getName()), source)
            else:
                options = self._jvm.org.apache.hadoop.fs.Options
                none = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
                none[0] = getattr(options, "Rename").NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(real.toUri(), self._conf).rename(temp, target, none)
            return True
        except Py4JJavaError as exc:
            if "FileAlreadyExists" in exc.java_exception.getClass().getName():
                return False
            raise
