"""Versions of what a store holds, as small JSON files that are written once."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

KEPT = 20  # versions; older ones are removed
TRIES = 100


class Files:
    """Small files on whatever file system a folder is on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway, self.folder = spark.sparkContext._gateway, folder
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        folder = self._path("")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), False)

    def create(self, name: str, text: str) -> bool:
        """Write a file that appears whole; False, and nothing done, if there is one of that name."""
        part = f".{name}-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(part), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.NONE
        source, target = (self.fs.makeQualified(self._path(n)) for n in (part, name))
        try:
            context.rename(source, target, how)
            return True
        except Exception as exc:
            if "FileAlreadyExists" not in str(exc):
                raise
            self.remove(part)
            return False


class Manifest:
    """The latest version is what the store holds; a change is a further version.

    A version appears whole or not at all, and two writers cannot make the same
    one: who comes second reads the other's and makes its change to that.
    """

    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, folder: str, empty: dict):
        self.files, self.empty = Files(spark, folder), empty

    def _versions(self) -> list[str]:
        return [n for n in self.files.names() if n.endswith(".json") and not n.startswith(".")]

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> tuple[int, dict]:
        for _ in range(TRIES):
            versions = self._versions()
            if not versions:
                return 0, json.loads(json.dumps(self.empty))
            try:
                return int(versions[-1].removesuffix(".json")), json.loads(self.files.read(versions[-1]))
            except Exception as exc:  # removed between listing and reading, as newer ones came
                if "FileNotFound" not in str(exc):
                    raise
        raise RuntimeError(f"no steady version in {self.files.folder}")

    def change(self, how: Callable[[dict], None]) -> dict:
        """Apply ``how`` to the content and publish it; ``how`` may be called again, on newer content."""
        with self._lock:
            for attempt in range(TRIES):
                version, content = self.read()
                how(content)
                if self.files.create(f"{version + 1:012d}.json", json.dumps(content)):
                    for name in self._versions()[:-KEPT]:
                        self.files.remove(name)
                    return content
                time.sleep(min(0.01 * 2**attempt, 1))
        raise RuntimeError(f"could not publish a version in {self.files.folder}")
