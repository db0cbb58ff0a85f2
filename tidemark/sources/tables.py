"""Versioned tables in a shared folder: Parquet batches, and a numbered list of those that count.

A table's version is a file that lists its batches. Version files are immutable and made by an exclusive create, so that of two writers who start from one version only one succeeds; the other sees a collision and may try again on what is there now. Batches are written before the version that names them, so that a reader sees all of a batch or nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import IoError, RetryExhausted, SerdeError

#: Attempts of a compare-and-set append.
ATTEMPTS = 8


class Folder:
    """Small files of a Hadoop file system."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def names(self, below: str = "") -> list[str]:
        p = self._path(below)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def walk(self, below: str = "") -> list[str]:
        """All files below, as paths from the folder."""
        p = self._path(below)
        if not self.fs.exists(p):
            return []
        out, it = [], self.fs.listFiles(p, True)
        root = self.fs.makeQualified(self._path("")).toString()
        while it.hasNext():
            out.append(it.next().getPath().toString().removeprefix(root).lstrip("/"))
        return sorted(out)

    def read(self, name: str) -> str:
        if not self.fs.exists(self._path(name)):
            raise IoError(f"missing: {self.uri}/{name}")
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a temporary file and renames it, which fails if the name is taken: false then."""
        temp, to = self._path(f"{name}.{uuid.uuid4().hex}.tmp"), self._path(name)
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, to, none)
        except Py4JJavaError as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise IoError(str(e.java_exception)) from e
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Table:
    """One versioned table."""

    def __init__(self, spark: SparkSession, uri: str, schema: str):
        self.spark, self.schema, self.folder = spark, schema, Folder(spark, uri)
        self.uri = self.folder.uri

    def version(self) -> int:
        done = [n for n in self.folder.names("versions") if n.endswith(".json")]
        return int(max(done).removesuffix(".json")) if done else 0

    def batches(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        if not version:
            return []
        try:
            return json.loads(self.folder.read(f"versions/{version:012d}.json"))
        except ValueError as e:
            raise SerdeError(f"{self.uri}, version {version}: {e}") from e

    def read(self, version: int | None = None) -> DataFrame:
        paths = [f"{self.uri}/{b}" for b in self.batches(version)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> str:
        name = f"batch-{uuid.uuid4().hex}"
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(columns).write.option("compression", "zstd").parquet(f"{self.uri}/{name}")
        return name

    def _publish(self, version: int, batches: list[str]) -> bool:
        return self.folder.create(f"versions/{version:012d}.json", json.dumps(batches))

    def append(self, rows: DataFrame) -> None:
        """Adds a batch, after whatever else was added meanwhile."""
        batch = self._write(rows)
        for _ in range(1000):
            v = self.version()
            if self._publish(v + 1, [*self.batches(v), batch]):
                return
        raise RetryExhausted(self.uri)

    def compare_and_append(self, make: Callable[[DataFrame], DataFrame | None], attempts: int = ATTEMPTS) -> int:
        """Appends make(current rows) if nobody else wrote in between; else makes it again. None from make gives up. Returns the attempts used."""
        for n in range(1, attempts + 1):
            v = self.version()
            rows = make(self.read(v))
            if rows is None:
                return n
            batch = self._write(rows)
            if self._publish(v + 1, [*self.batches(v), batch]):
                return n
            self.folder.delete(batch)
        raise RetryExhausted(f"{self.uri}: {attempts} attempts")

    def append_new(self, rows: DataFrame, key: list[str]) -> None:
        """Rows whose key is there already are left out: immutable objects."""
        self.compare_and_append(lambda now: rows.dropDuplicates(key).join(now.select(key), key, "left_anti"))

    def replace(self, change: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> None:
        """A new version that holds change(current rows) alone. Those who read an older one still can, until vacuum."""
        for _ in range(attempts):
            v = self.version()
            batch = self._write(change(self.read(v)))
            if self._publish(v + 1, [batch]):
                return
            self.folder.delete(batch)
        raise RetryExhausted(f"{self.uri}: {attempts} attempts")

    def vacuum(self, keep: int = 10) -> int:
        """Deletes batches that none of the newest keep versions lists, and older version files; returns how many batches went. Batches that no version has named yet stay: someone may be about to publish them."""
        now = self.version()
        old = [v for v in range(1, now - keep + 1) if f"{v:012d}.json" in self.folder.names("versions")]
        listed = {b for v in range(max(1, now - keep + 1), now + 1) for b in self.batches(v)}
        gone = {b for v in old for b in self.batches(v)} - listed
        for b in gone:
            self.folder.delete(b)
        for v in old:
            self.folder.delete(f"versions/{v:012d}.json")
        return len(gone)
