"""A log of micro-batches that compacts itself.

A batch is written as a folder and becomes valid with the next manifest. When
``FANOUT`` folders of one level have come together, they are combined into
one folder of the next level, which replaces them with one manifest: readers
have either the old folders or the new one. So n batches are read as about
``FANOUT`` x log(n) folders.

A batch that runs again after a failure is skipped if a manifest has it, and
else written anew under another name, so it counts once in any case. Folders
that a failed run has left are named by no manifest; those that a compaction
has replaced are deleted once the next manifest is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from larder.sources.manifest import Manifest

FANOUT = 8


class BatchLog:
    """Rows of ``schema`` in batches. ``combine`` reduces the rows of several
    batches to rows of the same schema that mean the same."""

    def __init__(self, spark: SparkSession, location: str, schema: StructType, combine: Callable[[DataFrame], DataFrame]):
        self.spark, self.base, self.schema, self.combine = spark, location.rstrip("/"), schema, combine
        self.manifest = Manifest(spark, self.base)

    def state(self) -> dict:
        return self.manifest.read() or {"batch": -1, "note": None, "folders": [], "replaced": []}

    def append(self, batch_id: int, rows: DataFrame, note=None) -> None:
        """Add a batch; ``note`` is a small value kept with the last batch."""
        now = self.state()
        if batch_id <= now["batch"]:
            return
        folders = [*now["folders"], {"name": self._write(rows), "level": 0}]
        now = {"batch": batch_id, "note": note, "folders": folders, "replaced": self._discarded(now)}
        self.manifest.commit(now)
        self.compact()

    def compact(self) -> None:
        now = self.state()
        while True:
            levels = [f["level"] for f in now["folders"]]
            full = next((x for x in sorted(set(levels)) if levels.count(x) >= FANOUT), None)
            if full is None:
                return
            old = [f for f in now["folders"] if f["level"] == full]
            new = {"name": self._write(self.combine(self._read(old))), "level": full + 1}
            kept = [f for f in now["folders"] if f["level"] != full]
            now = now | {"folders": [*kept, new], "replaced": [*self._discarded(now), *[f["name"] for f in old]]}
            self.manifest.commit(now)

    def _discarded(self, now: dict) -> list[str]:
        """Delete what the last manifest no longer names (readers of the one
        before are done with it by the next commit)."""
        for name in now["replaced"]:
            self.manifest.discard(name)
        return []

    def _write(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.base}/{name}")
        return name

    def _read(self, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{f['name']}" for f in folders])

    def read(self) -> DataFrame:
        """All valid rows, not combined."""
        return self._read(self.state()["folders"])
