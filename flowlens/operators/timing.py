"""Timing of operations, as rows for :func:`flowlens.operators.stats.operation_timing`."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from flowlens.session import work_path

SCHEMA = "name string, duration double"


class TimingLog:
    """Durations of the operations run under :meth:`track`, one row per call.

    The driver holds at most ``limit`` rows; as many are moved to a table in the shared folder.
    """

    def __init__(self, limit: int = 10_000) -> None:
        self.rows: list[tuple[str, float]] = []
        self.limit = limit
        self._moved: str | None = None

    @contextmanager
    def track(self, name: str) -> Iterator[None]:
        """Time a block, or with ``@log.track(name)`` every call of a function.

        A failing operation is timed as well. Building a DataFrame takes no time to speak
        of, so the block should hold the action.
        """
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - start))
            spark = SparkSession.getActiveSession()
            if len(self.rows) >= self.limit and spark is not None:
                self._move(spark)

    def _move(self, spark: SparkSession) -> None:
        self._moved = self._moved or work_path(spark, "timings")
        held = spark.createDataFrame(self.rows, SCHEMA)
        held.coalesce(1).write.mode("append").json(self._moved)
        self.rows = []

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows since the start or the last :meth:`flush`."""
        held = spark.createDataFrame(self.rows, SCHEMA)
        return held if self._moved is None else spark.read.schema(SCHEMA).json(self._moved).unionByName(held)

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append the rows to a stored log and start afresh."""
        self.table(spark).coalesce(1).write.mode("append").json(path)
        self.rows, self._moved = [], None
