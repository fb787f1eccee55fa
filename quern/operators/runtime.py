"""Which domains are loaded: a driver-side registry whose snapshot is a table."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: States of a domain.
STATES = ["not_built", "not_loaded", "initializing", "ready", "failed"]


class Domains:
    """Loads each domain's table once, whoever asks first; others wait for that load. A failed load may be tried again."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame | None]]):
        self._loaders = loaders
        self._state = {name: "not_loaded" for name in loaders}
        self._error: dict[str, str] = {}
        self._took: dict[str, float] = {}
        self._tables: dict[str, DataFrame] = {}
        self._locks = {name: threading.Lock() for name in loaders}

    def get(self, name: str) -> DataFrame:
        """The domain's table. A loader that returns None has no index yet: LookupError. What a loader raises is kept as its error and raised again."""
        with self._locks[name]:
            if name not in self._tables:
                self._state[name] = "initializing"
                began = time.monotonic()
                try:
                    table = self._loaders[name]()
                except Exception as e:
                    self._state[name], self._error[name] = "failed", str(e)
                    raise
                if table is None:
                    self._state[name] = "not_built"
                    raise LookupError(name)
                self._tables[name], self._state[name], self._took[name] = table, "ready", time.monotonic() - began
                self._error.pop(name, None)
            return self._tables[name]

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """``domain, state, ready, seconds, error``."""
        rows = [(n, s, s == "ready", self._took.get(n), self._error.get(n)) for n, s in self._state.items()]
        return spark.createDataFrame(rows, "domain string, state string, ready boolean, seconds double, error string")
