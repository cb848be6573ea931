"""Vocabulary files on executors: read once on the driver, broadcast (their size is that of the file), parsed once a worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_PARSED: dict = {}


class FileOnWorkers:
    """Content of a vocabulary file; ``parsed(f)`` keeps f(content) for the life of a Python worker."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self._content = spark.sparkContext.broadcast(f.read())
        self._path = path

    def parsed(self, parse: Callable[[bytes], object]):
        key = self._path, parse.__module__, parse.__qualname__
        if key not in _PARSED:
            _PARSED[key] = parse(self._content.value)
        return _PARSED[key]


class BoundedCache(dict):
    """Results of ``make(key)``; emptied when it holds ``limit`` of them. Only speed depends on it."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        value = self._make(key)
        if len(self) >= self._limit:
            self.clear()
        self[key] = value
        return value
