"""Scan counters, traffic windows, detection feeds and live counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.filters import alerts, syn_only
from flowlens.operators.stats import SKETCH_BITS, traffic_over_time
from flowlens.session import work_path


def without_duplicates(packets: DataFrame, time: str = "timestamp", delay: str = "10 minutes"):
    """Drop packets behind the watermark and repeats of a ``packet_id`` within it."""
    return packets.withWatermark(time, delay).dropDuplicatesWithinWatermark(["packet_id"])


def scan_counter_stream(
    packets: DataFrame, time: str = "timestamp", width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """SYN counts and how many ports each source tried per target and window.

    The ports are kept as the sketch of :func:`stats.port_sketches`, which comes along as ``ports``
    and can be merged with stored ones: exact for some hundreds of ports, about 1.6 % off beyond.
    Its size is bounded, so state grows with active pairs, not with ports.
    """
    named = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("src_ip", "dst_ip")]
    seen = packets.withWatermark(time, delay).where(F.col("protocol").isin("tcp", "udp"))
    seen = seen.where(named[0] & named[1])
    port = F.nullif(F.col("dst_port").cast("bigint"), F.lit(0).cast("bigint"))
    return (
        seen.groupBy(F.window(time, width).alias("bucket"), "protocol", "src_ip", "dst_ip")
        .agg(
            F.hll_sketch_agg(port, SKETCH_BITS).alias("ports"),
            F.count_if(syn_only(packets)).alias("syn_packets"),
        )
        .select(
            F.col("bucket.start").alias("window_start"), "protocol", "src_ip", "dst_ip",
            F.hll_sketch_estimate("ports").alias("n_ports"), "syn_packets", "ports",
        )
    )


def traffic_stream(
    detections: DataFrame, width: str = "1 minute", slide: str | None = None,
    time: str = "timestamp", delay: str = "10 minutes",
) -> DataFrame:
    """Packets, bytes and alerts per window, for update or append mode."""
    return traffic_over_time(detections.withWatermark(time, delay), width, slide, time)


def observed(detections: DataFrame, name: str = "counters") -> tuple[DataFrame, Observation]:
    """The same rows, counted as they pass: packets and alerts."""
    seen = Observation(name)
    counted = detections.observe(
        seen,
        F.count(F.lit(1)).alias("total_packets_processed"),
        F.count_if("is_alert").alias("total_alerts_generated"),
    )
    return counted, seen


def detection_feed(
    packets: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    detections_path: str,
    alerts_path: str,
    checkpoint: str,
    after_batch: Callable[[int], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Score each micro-batch, write its detections and its alerts.

    A batch writes into a folder named after its number and replaces that folder when it
    is run again, so a retried batch leaves no repeats. ``after_batch`` is the place for
    the periodic retrain check.
    """

    def handle(batch: DataFrame, number: int) -> None:
        found = detect(batch).persist()
        try:
            found.write.mode("overwrite").parquet(f"{detections_path}/batch={number}")
            alerts(found).write.mode("overwrite").parquet(f"{alerts_path}/batch={number}")
        finally:
            found.unpersist()
        if after_batch:
            after_batch(number)

    writer = packets.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_available(
    stream: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Run a stream over the input there is and return what it wrote.

    With the ``path`` and ``checkpoint`` of an earlier run it goes on where that one ended.

    Append mode writes parquet files. The other modes keep only the newest batch of
    changed rows per batch number, which a reader then folds by key.
    """
    spark = stream.sparkSession
    path = path or work_path(spark, name)
    checkpoint = checkpoint or work_path(spark, f"{name}-checkpoint")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:

        def handle(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        writer = stream.writeStream.foreachBatch(handle)
    query = (
        writer.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(_with_batch(stream, mode)).parquet(path)


def _with_batch(stream: DataFrame, mode: str):
    from pyspark.sql import types as T

    fields = list(stream.schema.fields)
    return T.StructType(fields + ([] if mode == "append" else [T.StructField("batch", T.LongType())]))
