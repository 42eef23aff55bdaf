"""Timings and counters of running streams, written as they go to a table of bounded size."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowlens.sources.files import hadoop, put

#: Batches kept per stream.
KEEP = 1_000
_PROGRESS = (
    "query_id string, query_name string, batch_id bigint, at string, rows bigint, "
    "durations map<string,bigint>, counters map<string,map<string,double>>"
)


class ProgressTable(StreamingQueryListener):
    """Writes a small file per micro-batch: milliseconds per operation, and observed counters.

    Files are named after the stream and the batch number modulo ``keep``, so the newest ``keep``
    batches of a stream are there, whatever its age, and nothing gathers on the driver. A batch that
    runs again after a restart from its checkpoint replaces its file. Only counters that are
    numbers are kept. A write that fails is counted in ``lost`` and does not stop the stream.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.lost = 0
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counters = {
            name: {k: float(v) for k, v in row.asDict().items() if isinstance(v, int | float)}
            for name, row in progress.observedMetrics.items()
        }
        entry = {
            "query_id": str(progress.id), "query_name": progress.name, "batch_id": progress.batchId,
            "at": progress.timestamp, "rows": progress.numInputRows,
            "durations": dict(progress.durationMs), "counters": counters,
        }
        try:
            slot = f"{self.path}/{progress.id}/{progress.batchId % self.keep:09d}.json"
            put(self.spark, slot, json.dumps(entry), replace=True)
        except Exception:
            self.lost += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def settled(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until all that a stopped stream reported has been written."""
        run = str(query.runId)
        with self._news:
            if not self._news.wait_for(lambda: run in self._ended, seconds):
                raise TimeoutError(f"the end of stream {run} was not reported within {seconds} s")
            self._ended.discard(run)


@contextmanager
def recorded(spark: SparkSession, path: str, keep: int = KEEP) -> Iterator[ProgressTable]:
    """Record the streams of a session while the block runs."""
    table = ProgressTable(spark, path, keep)
    spark.streams.addListener(table)
    try:
        yield table
    finally:
        spark.streams.removeListener(table)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per recorded micro-batch, with its durations in ms and its observed counters.

    Where nothing was recorded yet there are no rows.
    """
    parent, system = hadoop(spark, path)
    if not system.exists(parent):
        return spark.createDataFrame([], _PROGRESS)
    return spark.read.schema(_PROGRESS).json(f"{path.rstrip('/')}/*/*.json")


def operations(recorded: DataFrame) -> DataFrame:
    """One row per batch and operation, ``duration`` in seconds, as :func:`stats.operation_timing` takes them."""
    rows = recorded.select("query_id", "query_name", "batch_id", "rows", F.explode("durations").alias("name", "_ms"))
    return rows.select("*", (F.col("_ms") / 1000.0).alias("duration")).drop("_ms")


def observed_counters(recorded: DataFrame, name: str = "counters") -> DataFrame:
    """One row per batch and counter observed under ``name``."""
    rows = recorded.where(F.col("counters").getItem(name).isNotNull())
    return rows.select("query_id", "query_name", "batch_id", F.explode(F.col("counters").getItem(name)).alias("counter", "value"))
