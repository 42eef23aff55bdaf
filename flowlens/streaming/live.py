"""Live detection: running flow statistics in the state store, saved models, and their vote.

One stream takes packets to detections. The only stateful step keeps numbers of fixed size for
each open flow, and takes many flows in one call; preparation, scoring and the vote stay on the packet's row, as in the batch
job, and use the newest published version of every model at each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from flowlens.operators.features import basic_features, packet_size, time_features, with_event_time, with_flow_key
from flowlens.operators.filters import alerts
from flowlens.operators.flows import KEYLESS_GROUPS, TIMEOUT_S
from flowlens.operators.prep import Preprocessor
from flowlens.plans.detection import KEEP, vote_on_features
from flowlens.schemas import ALL_FEATURES, BASIC_FEATURES, FLOW_FEATURES, TIME_FEATURES
from flowlens.sources.versions import Loaded, choose
from flowlens.streaming.flows import FLOW_GROUPS, STATE, advance_flows, flow_group, open_table, state_row

#: Seconds, by the time of micro-batches, for which a flow without packets is remembered.
KEEP_S = 3_600.0
#: Packets of one group of flows and micro-batch that are put in order in memory; more are cut into
#: time slices of so many microseconds in the state store, and taken slice by slice.
HELD_ROWS, SLICE_US = 100_000, 1_000_000
#: Packets of a group that come out at a time.
PIECE_ROWS = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUP_STATE = f"{STATE}, arrived_ms array<bigint>"
#: The slice of packets without a time, after all others.
_LAST = 1 << 62
_COUNTS = ["flow_packets", "flow_bytes", "flow_packet_size_min", "flow_packet_size_max"]


class FlowProcessor(StatefulProcessor):
    """Adds the flow features to the packets of one group of flows, in the order of time and id."""

    def __init__(self, columns: list[str], timeout_us: int, keep_ms: int, held_rows: int, slice_us: int):
        self.columns = columns
        self.timeout_us, self.keep_ms, self.held_rows, self.slice_us = timeout_us, keep_ms, held_rows, slice_us

    def init(self, handle) -> None:
        self.handle = handle
        self.flows = handle.getValueState("flows", GROUP_STATE)
        # parts of a long micro-batch, by time slice; empty between micro-batches
        self.parts = handle.getMapState("parts", "slice bigint, part int", "rows binary")

    def _in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The packets in time order, in frames of bounded size."""
        held, rows, slices = [], 0, {}
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows > self.held_rows:
                self._put(held, slices)
                held, rows = [], 0
        if not slices:
            if held:
                yield pd.concat(held).sort_values(["t_us", "packet_id"], kind="stable")
            return
        self._put(held, slices)
        for name in sorted(slices):
            own = [pd.read_parquet(BytesIO(self.parts.getValue((name, part))[0])) for part in range(slices[name])]
            for part in range(slices[name]):
                self.parts.removeKey((name, part))
            yield pd.concat(own).sort_values(["t_us", "packet_id"], kind="stable")

    def _put(self, held: list[pd.DataFrame], slices: dict[int, int]) -> None:
        if not held:
            return
        frame = pd.concat(held)
        for name, own in frame.groupby((frame["t_us"] // self.slice_us).fillna(_LAST)):
            out = BytesIO()
            own.to_parquet(out, index=False)
            part = slices.get(int(name), 0)
            self.parts.updateValue((int(name), part), (out.getvalue(),))
            slices[int(name)] = part + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = next(rows, None)
        if first is None:
            return

        def frames():
            yield first
            yield from rows

        if first["flow_key"].isna().iloc[0]:  # such packets are in no flow
            for frame in frames():
                none = {c: pd.array([None] * len(frame), "Int64" if c in _COUNTS else "Float64") for c in FLOW_FEATURES}
                yield frame.assign(**none)[self.columns]
            return
        flows = self._stored()
        arrived = int(first["arrived"].iloc[0].timestamp() * 1000)
        for ordered in self._in_order(frames()):
            for at in range(0, len(ordered), PIECE_ROWS):
                piece = ordered.iloc[at : at + PIECE_ROWS].reset_index(drop=True)
                out, after = advance_flows(piece, flows, self.timeout_us)
                yield piece.iloc[out.index].assign(**{c: out[c].to_numpy() for c in FLOW_FEATURES})[self.columns]
                flows = after.assign(arrived_ms=after.reindex(columns=["arrived_ms"])["arrived_ms"].fillna(arrived).astype(np.int64))
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        self._store(flows[(flows["arrived_ms"] == arrived) | (flows["arrived_ms"] + self.keep_ms > watermark_ms)], watermark_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        flows = self._stored()
        self._store(flows[flows["arrived_ms"] + self.keep_ms > watermark_ms], watermark_ms)
        return iter([])

    def _stored(self) -> pd.DataFrame:
        row = self.flows.get() if self.flows.exists() else None
        arrived = [] if row is None else list(row[-1])
        return open_table(None if row is None else row[:-1]).assign(arrived_ms=np.array(arrived, dtype=np.int64))

    def _store(self, flows: pd.DataFrame, watermark_ms: int) -> None:
        """Keep the flows, and a timer for the one to be forgotten first."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if flows.empty:
            self.flows.clear()
            return
        self.flows.update((*state_row(flows), flows["arrived_ms"].tolist()))
        self.handle.registerTimer(max(int(flows["arrived_ms"].min()) + self.keep_ms, watermark_ms + 1))

    def close(self) -> None:
        pass


def live_features(
    packets: DataFrame, keep: tuple[str, ...] = KEEP, timeout_s: float = TIMEOUT_S, keep_s: float = KEEP_S,
    held_rows: int = HELD_ROWS, slice_us: int = SLICE_US,
) -> DataFrame:
    """The 23 features of each packet of a stream next to the ``keep`` columns, as in ``extract_features``.

    Packets of one micro-batch are put in the order of time and id; a packet older than the
    last one of a micro-batch before is counted without moving the flow's end back. A pause of
    more than the timeout between a flow's packets starts a new session. A flow of which no
    packet came for ``keep_s`` seconds between micro-batches is forgotten by a timer. Packets' own
    times close no flow but their own, so one that is dated ahead does no harm to others.
    Packets without a flow key have NULL statistics. Needs the RocksDB state store (``live_feed`` sets it).
    """
    df = packets if "t_us" in packets.columns else with_event_time(packets)
    df = with_flow_key(df)
    df = time_features(basic_features(df.withColumn("packet_size", packet_size(df))))
    other = [c for c in keep if c != "packet_id"]
    keyless = F.pmod(F.xxhash64("packet_id"), F.lit(KEYLESS_GROUPS)).cast("int") + FLOW_GROUPS
    group = F.when(F.col("flow_key").isNotNull(), flow_group("flow_key")).otherwise(keyless)
    # The clock of the timers is the micro-batch's own time, which is later than any before: no
    # packet is late, whatever its own time, and a repeated micro-batch has the same time.
    df = df.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    ready = df.select(
        group.alias("group"), "flow_key", F.col("t_us").cast("bigint").alias("t_us"),
        F.col("packet_id").cast("bigint").alias("packet_id"), *[F.col(c).alias(f"kept_{c}") for c in other],
        *BASIC_FEATURES, *TIME_FEATURES, "arrived",
    )
    kinds = {c: T.LongType() if c in _COUNTS else T.DoubleType() for c in FLOW_FEATURES}
    out = T.StructType(ready.schema.fields[1:-1] + [T.StructField(c, k) for c, k in kinds.items()])
    processor = FlowProcessor(out.names, round(timeout_s * 1_000_000), round(keep_s * 1000), held_rows, slice_us)
    running = ready.groupBy("group").transformWithStateInPandas(processor, out, "Append", "EventTime")
    return running.select("packet_id", *[F.col(f"kept_{c}").alias(c) for c in other], *ALL_FEATURES).select(*keep, *ALL_FEATURES)


def live_feed(
    packets: DataFrame, preprocessor: Preprocessor, models: str, detections: str, alarms: str, checkpoint: str,
    mode: str = "reference", after_batch: Callable[[int], None] | None = None, available_now: bool = True, **options,
) -> StreamingQuery:
    """Packets to detections and alerts, by the newest models published in the folder ``models``.

    Each micro-batch notes the versions it uses before it scores, so a repeated one uses the
    same, and writes into folders named after its number, which a repeat replaces.
    ``after_batch`` is the place for :func:`flowlens.plans.retraining.retrain_if_due`.
    """
    spark = packets.sparkSession
    loaded = Loaded()

    def handle(batch: DataFrame, number: int) -> None:
        versions = choose(batch.sparkSession, models, f"{detections}-versions/batch-{number}.json")
        voters = [(v.model, model, v.weight, len(v.labels)) for v, model in loaded.get(versions)]
        found = vote_on_features(batch, preprocessor, voters, mode).persist()
        try:
            found.write.mode("overwrite").parquet(f"{detections}/batch={number}")
            alerts(found).write.mode("overwrite").parquet(f"{alarms}/batch={number}")
        finally:
            found.unpersist()
        if after_batch:
            after_batch(number)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings it starts with
    try:
        writer = live_features(packets, **options).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
