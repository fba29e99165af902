"""Named spans of time of a run, nested, with the Spark jobs of each under its name."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Spans:
    """Seconds of named spans in the order in which they end: records are (path of names, seconds)."""

    def __init__(self, spark: SparkSession | None = None):
        self.records: list[tuple[str, float]] = []
        self._open: list[str] = []
        self._context = spark.sparkContext if spark else None

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        self._open.append(name)
        path, began = "/".join(self._open), time.perf_counter()
        if self._context:
            self._context.setJobDescription(path)
        try:
            yield
        finally:
            self.records.append((path, time.perf_counter() - began))
            self._open.pop()
            if self._context:
                self._context.setJobDescription("/".join(self._open) or None)
