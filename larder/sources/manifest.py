"""Manifests: what a folder's valid contents are, replaced as a whole.

Each version is one small file with a number as its name, written aside and
renamed, so readers see the last complete version and never a half-written
one. Data that no manifest names does not exist for them: a run that fails
before its commit leaves nothing visible.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """The versions of ``base``'s contents. One writer at a time."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/manifest/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self) -> dict | None:
        """The last committed contents, or None before the first commit."""
        found = self.versions()
        if not found:
            return None
        stream = self._fs.open(self._path(f"{found[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, contents: dict, keep: int = 2) -> None:
        """Make ``contents`` the valid ones; the last ``keep`` versions stay."""
        found = self.versions()
        version = found[-1] + 1 if found else 0
        aside = self._path(f"_{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(contents).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"{version:012d}.json")):
            raise OSError(f"manifest {version} of {self.base} was not committed")
        for old in found[:len(found) + 1 - keep]:
            self._fs.delete(self._path(f"{old:012d}.json"), False)

    def discard(self, folder: str) -> None:
        """Delete a folder below ``base`` that no valid manifest names."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}"), True)
