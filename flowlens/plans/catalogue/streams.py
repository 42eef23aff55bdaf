"""Streaming jobs run to the end of the given tables, next to their batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import filters, scoring
from flowlens.operators.features import with_flow_key
from flowlens.plans.catalogue import query
from flowlens.plans.catalogue.detecting import (
    DETECTION_SQL,
    WITH_FEEDBACK,
    _shown,
    _traffic_sql,
    feedback_entries,
    wide_scores,
)
from flowlens.plans.catalogue.features import (
    FLOW_COLUMNS,
    KEYED,
    REAL_FLOW,
    SESSIONS,
    SUMMARY_COLUMNS,
    WITH_RUNNING,
    rounded,
)
from flowlens.plans.views import WITH_PACKETS, WITH_VOTES, packets_of, table
from flowlens.schemas import FLOW_FEATURES
from flowlens.session import work_path
from flowlens.streaming import feeds, timings
from flowlens.streaming import flows as stream_flows
from flowlens.sources.packets import stream_packets


def packet_stream(spark, folder):
    """The packets view over the events file, read as a stream."""
    schema = table(spark, folder, "events").schema
    events = stream_packets(
        spark, folder, "parquet", schema, pathGlobFilter="events.parquet", maxFilesPerTrigger=1
    )
    return packets_of(events).withColumn("timestamp", F.timestamp_micros("t_us"))


STREAM_RUNNING_SQL = f"{WITH_RUNNING} select packet_id, flow_key, {FLOW_COLUMNS} from running"


@query("stream_flow_running", STREAM_RUNNING_SQL)
def stream_flow_running(spark, folder):
    """Open flows in a table, one batch job per micro-batch."""
    output = work_path(spark, "flow-feed")
    stream_flows.running_flow_feed(
        with_flow_key(packet_stream(spark, folder)),
        output,
        work_path(spark, "open-flows"),
        work_path(spark, "flow-feed-checkpoint"),
    ).awaitTermination()
    out = spark.read.parquet(output).select("packet_id", "flow_key", *FLOW_FEATURES)
    return rounded(out, REAL_FLOW)


@query("stream_flow_state", STREAM_RUNNING_SQL)
def stream_flow_state(spark, folder):
    """Open flows in Spark's state store, one Python call per group of flows and micro-batch."""
    stream = stream_flows.running_flow_stream(with_flow_key(packet_stream(spark, folder)))
    out = feeds.run_available(stream, "stream-flows")
    return rounded(out.select("packet_id", "flow_key", *FLOW_FEATURES), REAL_FLOW)


@query("stream_flow_summary", f"""{WITH_PACKETS}, {KEYED}, {SESSIONS}
select flow_key, start_us, end_us, flow_packets, flow_bytes,
  round(flow_duration, 6) as flow_duration, flow_packet_size_mean, flow_packet_size_std,
  flow_packet_size_min, flow_packet_size_max
from (select flow_key, flow_session, {SUMMARY_COLUMNS} from sessions group by flow_key, flow_session) s""")
def stream_flow_summary(spark, folder):
    """All sessions: those the stream closed, and those open in its state when the input ended.

    The packets come in three deliveries, with a restart before each; every tenth packet comes five
    minutes late, and every seventh again two minutes later.
    """
    packets, arrived = deliveries(spark, folder), work_path(spark, "deliveries")
    path, checkpoint = work_path(spark, "closed-flows"), work_path(spark, "closed-flows-checkpoint")
    for number in range(DELIVERIES):
        packets.where(F.col("delivery") == number).drop("delivery").write.parquet(f"{arrived}/{number}")
        stream = stream_packets(spark, arrived, "parquet", packets.drop("delivery").schema, recursiveFileLookup="true")
        closing = stream_flows.closed_flow_stream(stream, delay="10 minutes", repeated=True)
        closed = feeds.run_available(closing, "closed-flows", path=path, checkpoint=checkpoint)
    out = closed.unionByName(stream_flows.open_flows(spark, checkpoint))
    return rounded(out, [c for c in REAL_FLOW if c in out.columns])


DELIVERIES = 3


def deliveries(spark, folder):
    """The packets with the delivery they arrive in, some late and some twice."""
    packets = with_flow_key(packets_of(table(spark, folder, "events")))
    late = F.when(F.col("packet_id") % 10 == 0, 5 * 60_000_000).otherwise(0)
    again = F.when(F.col("packet_id") % 7 == 0, F.array(F.lit(0), F.lit(2 * 60_000_000))).otherwise(F.array(F.lit(0)))
    packets = packets.withColumn("_again", F.explode(again))
    packets = packets.withColumn("_arrives", F.col("t_us") + late + F.col("_again"))
    low, high = packets.agg(F.min("_arrives"), F.max("_arrives")).first()
    if low is None:
        return packets.withColumn("delivery", F.lit(0)).drop("_arrives", "_again")
    share = (F.col("_arrives") - low) / (high - low + 1)
    packets = packets.withColumn("delivery", F.floor(share * DELIVERIES).cast("int"))
    return packets.drop("_arrives", "_again")


@query("stream_scan_counters", f"""{WITH_PACKETS} select
  make_timestamp(t_us // 300000000 * 300000000) as window_start, protocol, src_ip, dst_ip,
  count(*) filter (protocol = 'tcp' and tcp_flags & 2 <> 0 and tcp_flags & 16 = 0) as syn_packets,
  count(distinct nullif(dst_port, 0)) as n_ports from packets where protocol in ('tcp', 'udp') group by all""")
def stream_scan_counters(spark, folder):
    """Few ports are tried here per pair and window, so the sketches count them exactly."""
    stream = feeds.scan_counter_stream(packet_stream(spark, folder), width="5 minutes")
    changes = feeds.run_available(stream, "stream-scans", mode="update")
    newest = changes.groupBy("window_start", "protocol", "src_ip", "dst_ip").agg(
        F.max("syn_packets").alias("syn_packets"), F.max("n_ports").alias("n_ports")
    )
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_traffic", _traffic_sql(60_000_000))
def stream_traffic(spark, folder):
    voted = scoring.vote_wide(packet_stream(spark, folder), wide_scores())
    voted = voted.withColumn("is_alert", F.col("prediction") != "normal")
    changes = feeds.run_available(feeds.traffic_stream(voted), "stream-traffic", mode="update")
    # A window's counts only grow, so its newest row is its largest.
    newest = changes.groupBy("window_start").agg(
        *[F.max(c).alias(c) for c in ("packets", "bytes", "alerts")]
    )
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_deduplicated", f"{WITH_PACKETS} select packet_id, src_ip from packets")
def stream_deduplicated(spark, folder):
    """Every packet is delivered twice and comes out once."""
    stream = packet_stream(spark, folder)
    doubled = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = feeds.without_duplicates(doubled).select("packet_id", "src_ip")
    return feeds.run_available(once, "stream-once")


def _detect(batch):
    return scoring.detect(batch, wide_scores(), F.col("t_us") / 1e6)


@query("stream_detections", f"{WITH_VOTES} select {DETECTION_SQL}, 'detection' as feed from detections "
       f"union all select {DETECTION_SQL}, 'alert' from detections where is_alert")  # fmt: skip
def stream_detections(spark, folder):
    found, alarms = work_path(spark, "detections"), work_path(spark, "alerts")
    feeds.detection_feed(
        packet_stream(spark, folder), _detect, found, alarms, work_path(spark, "detect-checkpoint")
    ).awaitTermination()
    columns = [c for c in scoring.DETECTION_COLUMNS]
    detections = spark.read.parquet(found).select(*columns, F.lit("detection").alias("feed"))
    alerts = spark.read.parquet(alarms).select(*columns, F.lit("alert").alias("feed"))
    return _shown(detections.union(alerts))


@query("stream_counters", f"""{WITH_VOTES} select count(*) as total_packets_processed,
  count(*) filter (is_alert) as total_alerts_generated from detections""")
def stream_counters(spark, folder):
    """Counts observed on the rows of each micro-batch as they pass, then summed."""
    seen = work_path(spark, "observed")

    def handle(batch, number):
        counted, observation = feeds.observed(_detect(batch), f"counters-{number}")
        counted.write.format("noop").mode("overwrite").save()
        one = spark.createDataFrame([observation.get], "total_packets_processed bigint, "
                                    "total_alerts_generated bigint")  # fmt: skip
        one.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    query_ = packet_stream(spark, folder).writeStream.foreachBatch(handle)
    query_ = query_.option("checkpointLocation", work_path(spark, "observe-checkpoint"))
    query_.trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(seen)
    return counts.agg(
        *[F.sum(c).alias(c) for c in ("total_packets_processed", "total_alerts_generated")]
    )


OPERATIONS = ("addBatch", "commitOffsets", "getBatch", "latestOffset", "queryPlanning", "triggerExecution", "walCommit")


@query("stream_timings", f"""{WITH_VOTES}, batches as (select packet_id % 4 as batch_id, count(*) as rows,
    count(*) filter (is_alert) as alerts from detections group by 1)
  select batch_id::bigint as batch_id, name, rows, rows as packets, alerts, true as timed
  from batches cross join (values {", ".join(f"('{o}')" for o in OPERATIONS)}) o(name)""")
def stream_timings(spark, folder):
    """Packets in four deliveries, one per micro-batch: a row per batch and operation, with what was counted in it."""
    arrived, log = work_path(spark, "timed-in"), work_path(spark, "stream-timings")
    events = table(spark, folder, "events")
    for number in range(4):
        events.where(F.col("event_id") % 4 == number).coalesce(1).write.parquet(f"{arrived}/{number}")
    stream = stream_packets(spark, arrived, "parquet", events.schema, recursiveFileLookup="true", maxFilesPerTrigger=1)
    found = _detect(packets_of(stream)).observe(
        "counters", F.count(F.lit(1)).alias("packets"), F.count_if("is_alert").alias("alerts")
    )
    with timings.recorded(spark, log) as recorder:
        writer = found.writeStream.format("parquet").option("path", work_path(spark, "timed-out"))
        writer = writer.option("checkpointLocation", work_path(spark, "timed-checkpoint")).queryName("timed")
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination()
        recorder.settled(running)
    progress = timings.progress(spark, log).where(F.col("query_id") == str(running.id))
    rows = timings.operations(progress).where(F.col("name").isin(*OPERATIONS))
    seen = timings.observed_counters(progress).groupBy("batch_id").pivot("counter", ["packets", "alerts"]).agg(F.first("value"))
    return rows.join(seen, "batch_id").select(
        "batch_id", "name", "rows", *[F.col(c).cast("bigint").alias(c) for c in ("packets", "alerts")],
        (F.col("duration") >= 0).alias("timed"),
    )


@query("stream_retrain_check", f"""{WITH_FEEDBACK} select model_name, count(*) as n,
  count(*) >= 10 and model_name <> 'm2' as due from feedback group by model_name""")
def stream_retrain_check(spark, folder):
    """The retrain gate, checked after every micro-batch of the detection feed."""
    from flowlens.operators.feedback import retrain_due

    due = work_path(spark, "due")
    feedback = feedback_entries(spark, folder)
    trained = spark.createDataFrame([("m2", 1e9)], "model_name string, trained_at double")

    def check(number):
        now = retrain_due(feedback, trained, 1e9 + 100 + 3600 * number)
        now.write.mode("overwrite").parquet(f"{due}/batch={number}")

    feeds.detection_feed(
        packet_stream(spark, folder), _detect, work_path(spark, "detections"),
        work_path(spark, "alerts"), work_path(spark, "detect-checkpoint"), after_batch=check,
    ).awaitTermination()
    return spark.read.parquet(due).select("model_name", "n", "due")


@query("stream_filtered", f"{WITH_PACKETS} select packet_id, src_ip, dst_port from packets "
       "where dst_port = 53")  # fmt: skip
def stream_filtered(spark, folder):
    """The batch rule filter, unchanged, on a stream."""
    matching = filters.rule_filter(packet_stream(spark, folder), [("port", "dst_port", 53)])
    return feeds.run_available(matching.select("packet_id", "src_ip", "dst_port"), "stream-rules")


