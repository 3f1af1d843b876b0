"""Numbered commit records below a table's folder; the highest one is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """A record is written aside and renamed into place, so readers see it whole or not at all, and
    a run that fails before has changed nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._read = spark._jvm.org.apache.commons.io.IOUtils.toString
        self._folder = f"{path.rstrip('/')}/_commits"
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self._folder}/{name}" if name else self._folder)

    def _numbers(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._path(""))]
        return [int(name.removesuffix(".json")) for name in names if name.removesuffix(".json").isdigit()]

    def latest(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self._files.open(self._path(f"{max(numbers):012d}.json"))
        try:
            return json.loads(self._read(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, record: dict) -> None:
        aside = self._path(f".{uuid.uuid4().hex}")
        stream = self._files.create(aside, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        place = self._path(f"{max(self._numbers(), default=0) + 1:012d}.json")
        if self._files.exists(place) or not self._files.rename(aside, place):
            raise RuntimeError(f"another writer has committed {place.getName()}")
