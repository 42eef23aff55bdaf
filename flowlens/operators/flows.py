"""Flow sessions and flow statistics.

A flow is the traffic under one bidirectional key; a pause of more than the timeout ends
a session. Sessions need the packets of a key in time order, so the plain form is a
window per key. One busy key would then land in one task, so the rows of *hot* keys are
first cut into slices of about equal rows, at quantiles of their times (and of their packet
numbers, where many packets share one instant): windows run once per (key, slice), their
result is kept as a table, and a small table with one row per hot slice carries the open
session from slice to slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.numeric import sum_of_squares_sd
from flowlens.session import broadcast_if_small, materialized

TIMEOUT_S = 60.0
HOT_ROWS = 10_000_000
# A list of up to this many hot keys is broadcast; a longer one is joined by shuffle.
HOT_KEYS = 10_000
# Rows of a slice; a key of more than MAX_SLICES times as many gets larger slices.
SLICE_ROWS = 2_000_000
MAX_SLICES = 1024
# Sketches hold this many values per slice: their rank error is then below a third of a slice.
SKETCHED = 16
# Keys whose cut points (up to MAX_SLICES numbers each) are broadcast.
CUT_KEYS = 1_000
# Rows without a key belong to no flow; they are spread over this many groups.
KEYLESS_GROUPS = 4096

CARRY = ["n", "bytes", "squares", "low", "high", "start", "last"]


def hot_keys(
    packets: DataFrame, hot_rows: int = HOT_ROWS, limit: int = HOT_KEYS
) -> DataFrame | None:
    """The flow keys of more than ``hot_rows`` rows, with a broadcast hint up to ``limit`` keys.

    Beside them stand their ``_rows`` and ``_open_end``, the end of the session that was open before.

    Found by a job of its own, a count that is combined before its shuffle, so that a
    table without such keys gets the plain plan. None where there are none.
    """
    counts = packets.where(F.col("flow_key").isNotNull()).groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.when(F.col("_open"), F.col("t_us"))).alias("_open_end")
    )
    busy = counts.where(F.col("_rows") > hot_rows)
    keys = [tuple(row) for row in busy.limit(limit + 1).collect()]
    if not keys:
        return None
    if len(keys) > limit:
        return materialized(busy, "hot-keys")
    return F.broadcast(packets.sparkSession.createDataFrame(keys, "flow_key string, _rows bigint, _open_end bigint"))


def running_flows(
    packets: DataFrame,
    size: Column | None = None,
    timeout_s: float = TIMEOUT_S,
    hot_rows: int | None = HOT_ROWS,
    slice_s: float | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each packet with the statistics of its flow session so far.

    Needs ``flow_key``, ``t_us``, ``packet_id``; order is ``(t_us, packet_id)``. Adds
    ``flow_session`` (1, 2, ... per key) and the nine ``flow_*`` features, all NULL where
    the key is NULL. ``hot_rows=None`` skips the search for hot keys, for tables known to
    have none. A hot key is cut into slices of about ``slice_rows`` rows, however unevenly
    its packets lie in time, or into spans of ``slice_s`` seconds where that is given. The
    rows of hot keys are then written to the shared folder once.
    """
    x = F.col("packet_size") if size is None else size
    rows = packets.withColumns({"_open": F.lit(False), **_one_packet(x)})
    merged = _merge(rows, timeout_s, hot_rows, slice_s, slice_rows)
    return _with_features(merged, packets.columns)


def continue_flows(
    packets: DataFrame,
    open_flows: DataFrame,
    timeout_s: float = TIMEOUT_S,
    hot_rows: int | None = HOT_ROWS,
    slice_s: float | None = None,
    slice_rows: int = SLICE_ROWS,
    held: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Running statistics of further packets of flows, and the sessions then open.

    ``open_flows`` (see ``OPEN_FLOW``) holds one row per open session. Such a row takes
    part as a first entry of its key that stands for all packets before. A packet older
    than that is counted, but does not move the end of the session back. Packets without
    a key get NULL statistics. ``held`` is applied to the frame that both results read, for
    a caller that wants to persist it.
    """
    x = F.col("packet_size")
    rows = packets.withColumns({"_open": F.lit(False), **_one_packet(x)})
    before = open_flows.select(
        "flow_key",
        F.col("last_us").alias("t_us"),
        F.lit(True).alias("_open"),
        *[F.col(name).alias(f"_w_{c}") for name, c in zip(OPEN_STATS, CARRY, strict=True)],
    )
    merged = _merge(
        rows.unionByName(before, allowMissingColumns=True), timeout_s, hot_rows, slice_s, slice_rows
    )
    if held is not None:
        merged = held(merged)
    last = F.struct(~F.col("_open"), "t_us", "packet_id")
    stats = F.struct(
        *[F.col(f"_{c}").alias(name) for name, c in zip(OPEN_STATS, CARRY, strict=True)]
    )
    ends = merged.where(F.col("flow_key").isNotNull()).groupBy("flow_key").agg(F.max_by(stats, last).alias("s"))
    running = _with_features(merged.where(~F.col("_open")), packets.columns)
    return running, ends.select("flow_key", "s.*")


OPEN_FLOW = (
    "flow_key string, packets bigint, bytes bigint, squares decimal(28,0), low bigint, "
    "high bigint, start_us bigint, last_us bigint"
)
OPEN_STATS = ["packets", "bytes", "squares", "low", "high", "start_us", "last_us"]

_COMBINE = {
    "n": lambda a, b: a + b,
    "bytes": lambda a, b: a + b,
    "squares": lambda a, b: a + b,
    "low": F.least,
    "high": F.greatest,
    "start": F.least,
    "last": F.greatest,
}
_FOLD = {
    "n": F.sum,
    "bytes": F.sum,
    "squares": F.sum,
    "low": F.min,
    "high": F.max,
    "start": F.min,
    "last": F.max,
}


def _one_packet(size: Column) -> dict[str, Column]:
    """What one packet adds to the statistics."""
    return {
        "_w_n": F.lit(1).cast("bigint"),
        "_w_bytes": size,
        "_w_squares": (size * size).cast("decimal(20,0)"),
        "_w_low": size,
        "_w_high": size,
        "_w_start": F.col("t_us"),
        "_w_last": F.col("t_us"),
    }


def _merge(
    rows: DataFrame, timeout_s: float, hot_rows: int | None, slice_s: float | None, slice_rows: int
) -> DataFrame:
    """Rows with the running statistics ``_n`` ... ``_last`` and ``_session``."""
    timeout_us = round(timeout_s * 1_000_000)
    keyless = F.pmod(F.xxhash64("packet_id"), F.lit(KEYLESS_GROUPS))
    no_slice = F.when(F.col("flow_key").isNull(), keyless).otherwise(F.lit(0).cast("bigint"))
    result = [*rows.columns, *[f"_{c}" for c in CARRY], "_session"]

    hot = None if hot_rows is None else hot_keys(rows, hot_rows)
    plain = rows if hot is None else rows.join(hot, "flow_key", "left_anti")
    local = _local_stats(plain.withColumn("_slice", no_slice), timeout_us)
    local = local.withColumn("_session", F.col("_seg") + 1)
    if hot is None:
        return local

    busy = rows.join(hot.select("flow_key", "_open_end"), "flow_key")
    if slice_s is not None:
        sliced = busy.withColumn("_slice", F.expr(f"t_us div {round(slice_s * 1_000_000)}"))
    else:
        sliced = cut_by_rows(busy, hot.select("flow_key", "_rows"), slice_rows)
    # The entry of an open session comes before all slices of its key.
    first = F.when(F.col("_open"), -(2**62)).otherwise(F.coalesce("_slice", F.lit(-(2**61))))
    kept = materialized(_local_stats(sliced.withColumn("_slice", first), timeout_us), "hot-flows")
    joined = kept.join(_carried(kept, timeout_us), ["flow_key", "_slice"], "left")

    # Only the first segment of a slice continues the session carried into it.
    continues = F.coalesce((F.col("_seg") == 0) & F.col("_in_n").isNotNull(), F.lit(False))
    merged = {
        f"_{c}": F.when(continues, combine(F.col(f"_in_{c}"), F.col(f"_{c}"))).otherwise(
            F.col(f"_{c}")
        )
        for c, combine in _COMBINE.items()
    }
    joined = joined.withColumns({**merged, "_session": F.col("_base") + F.col("_seg")})
    return local.select(*result).unionByName(joined.select(*result))


def cut_by_rows(rows: DataFrame, keys: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of ``keys`` (``flow_key``, ``_rows``) with a ``_slice`` of about ``slice_rows`` rows of one key each.

    Slices follow the order ``(t_us, packet_id)``. Cut points are quantiles of a sketch of the
    times of each key. A time that is a cut point more than once holds more rows than a slice:
    it becomes slices of its own, cut at quantiles of a second sketch, of its packet numbers.
    Null times come first. Rows equal in both stay in one slice.
    """
    wanted = F.least(F.lit(MAX_SLICES), F.ceil(F.col("_rows") / slice_rows)).cast("int")
    most = keys.agg(F.max(wanted)).first()[0] or 1
    if most < 2:
        return rows.withColumn("_slice", F.lit(0).cast("bigint"))
    cuts = rows.groupBy("flow_key").agg(_quantiles("t_us", most).alias("_grid")).join(keys, "flow_key")
    cuts = cuts.select("flow_key", _spread(wanted, 4 * most).alias("_all"))
    cuts = materialized(
        cuts.select(
            "flow_key",
            F.array_distinct("_all").alias("_cuts"),
            F.expr("map_from_entries(transform(array_distinct(filter(_all, (c, i) -> i > 0 and c = _all[i - 1])), "
                   "c -> struct(c, size(filter(_all, d -> d = c)) + 1)))").alias("_instants"),
        ),
        "flow-cuts",
    )
    below = _count_below("_cuts", "t_us")
    placed = rows.join(broadcast_if_small(cuts, CUT_KEYS), "flow_key")
    is_instant = F.map_contains_key("_instants", F.coalesce("t_us", F.lit(0)))
    placed = placed.withColumn("_instant", F.col("t_us").isNotNull() & is_instant)
    placed = placed.withColumn("_slice", (2 * below + F.col("_instant").cast("bigint")) * MAX_SLICES)

    full = cuts.select("flow_key", F.explode("_instants").alias("t_us", "_parts"))
    most = full.agg(F.max("_parts")).first()[0]
    if most is None:
        return placed.select(*rows.columns, "_slice")
    same = placed.where("_instant").groupBy("flow_key", "t_us").agg(_quantiles("packet_id", most).alias("_grid"))
    same = same.join(full, ["flow_key", "t_us"])
    same = materialized(
        same.select("flow_key", "t_us", F.array_distinct(_spread(F.col("_parts"), 4 * most)).alias("_numbers")),
        "flow-instants",
    )
    placed = placed.join(broadcast_if_small(same, CUT_KEYS), ["flow_key", "t_us"], "left")
    within = F.coalesce(_count_below("_numbers", "packet_id"), F.lit(0))
    return placed.withColumn("_slice", F.col("_slice") + within).select(*rows.columns, "_slice")


def _quantiles(column: str, parts: int) -> Column:
    """Quantiles of a column at 4 * parts - 1 equal steps, from a sketch that is merged across tasks."""
    size = min(65_535, max(200, SKETCHED * parts))
    steps = [i / (4 * parts) for i in range(1, 4 * parts)]
    return F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(column, F.lit(size)), F.lit(steps))


def _spread(parts: Column, steps: int) -> Column:
    """The ``parts`` - 1 values of ``_grid``, the quantiles at ``steps`` equal steps, that cut into equal parts."""
    nth = F.transform(
        F.sequence(F.lit(1), F.greatest(parts, F.lit(2)) - 1),
        lambda i: F.get("_grid", (F.floor(i * steps / parts) - 1).cast("int")),
    )
    return F.when(parts > 1, nth).otherwise(F.array().cast("array<bigint>"))


def _count_below(cuts: str, value: str) -> Column:
    """How many of the ascending ``cuts`` lie below a value, by halving; 0 for a null value."""
    halves = F.array(*[F.lit(2**k) for k in reversed(range(MAX_SLICES.bit_length()))])
    step = lambda at, half: F.when(
        (at + half <= F.size(cuts)) & (F.get(cuts, at + half - 1) < F.col(value)), at + half
    ).otherwise(at)
    return F.aggregate(halves, F.lit(0), step).cast("bigint")


def _local_stats(rows: DataFrame, timeout_us: int) -> DataFrame:
    """Segments and running sums within each (key, slice); one shuffle on those columns."""
    order = [F.desc("_open"), F.col("t_us"), F.col("packet_id")]
    ordered = Window.partitionBy("flow_key", "_slice").orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    end = F.max("t_us").over(earlier)
    if "_open_end" in rows.columns:
        # The session open before may end later than the late packets of this slice.
        end = F.when(end.isNotNull(), F.greatest(end, "_open_end"))
    gap = F.col("t_us") - end
    rows = rows.withColumn("_new", F.when(gap > timeout_us, 1).otherwise(0))
    rows = rows.withColumn("_seg", F.sum("_new").over(so_far))
    run = (
        Window.partitionBy("flow_key", "_slice", "_seg")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    stats = {f"_{c}": fold(f"_w_{c}").over(run) for c, fold in _FOLD.items()}
    return rows.withColumns(stats)


def _carried(local: DataFrame, timeout_us: int) -> DataFrame:
    """One row per hot slice: its first session number and the statistics carried into it.

    A slice's last segment ("tail") is open at its end. Slices with a break at or inside
    them start a new group; the tails of one group add up to one open session.
    """
    last = F.struct("t_us", "packet_id")
    tail = [
        F.max_by(F.col(f"_{c}").cast("decimal(28,0)" if c == "squares" else "bigint"), last).alias(
            f"_tail_{c}"
        )
        for c in CARRY
    ]
    slices = local.groupBy("flow_key", "_slice").agg(
        F.min("t_us").alias("_first_t"),
        F.max("t_us").alias("_last_t"),
        F.max("_seg").alias("_breaks"),
        *tail,
    )
    key = Window.partitionBy("flow_key").orderBy("_slice")
    upto = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = key.rowsBetween(Window.unboundedPreceding, -1)
    previous_end = F.max("_last_t").over(earlier)
    opens = previous_end.isNull() | (F.col("_first_t") - previous_end > timeout_us)
    slices = slices.withColumn("_opens", opens.cast("bigint"))
    slices = slices.withColumns(
        {
            "_base": F.sum(F.col("_opens") + F.col("_breaks")).over(upto) - F.col("_breaks"),
            "_group": F.sum(
                F.when((F.col("_opens") == 1) | (F.col("_breaks") > 0), 1).otherwise(0)
            ).over(upto),
        }
    )
    group = (
        Window.partitionBy("flow_key", "_group")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    slices = slices.withColumns(
        {f"_out_{c}": fold(f"_tail_{c}").over(group) for c, fold in _FOLD.items()}
    )
    incoming = {
        f"_in_{c}": F.when(F.col("_opens") == 0, F.lag(f"_out_{c}").over(key)) for c in CARRY
    }
    return slices.withColumns(incoming).select("flow_key", "_slice", "_base", *incoming)


def _with_features(rows: DataFrame, columns: list[str]) -> DataFrame:
    n, total, squares = F.col("_n"), F.col("_bytes"), F.col("_squares")
    # A packet behind the end of its flow leaves the end where it is, so not ``t_us``.
    duration = F.greatest(F.lit(0.001), (F.col("_last") - F.col("_start")) / 1e6)
    features = {
        "flow_session": F.col("_session"),
        "flow_duration": duration,
        "flow_packets": n,
        "flow_bytes": total,
        "flow_rate_pps": n / duration,
        "flow_rate_bps": total / duration,
        "flow_packet_size_mean": total / n,
        "flow_packet_size_std": sum_of_squares_sd(n, total, squares),
        "flow_packet_size_min": F.col("_low"),
        "flow_packet_size_max": F.col("_high"),
    }
    in_flow = F.col("flow_key").isNotNull()
    return rows.select(
        *[F.col(c) for c in columns],
        *[F.when(in_flow, value).alias(name) for name, value in features.items()],
    )


def flow_sessions(packets: DataFrame, **options) -> DataFrame:
    """Packets with their session number only."""
    return running_flows(packets, **options).drop(
        "flow_duration", "flow_packets", "flow_bytes", "flow_rate_pps", "flow_rate_bps",
        "flow_packet_size_mean", "flow_packet_size_std",
        "flow_packet_size_min", "flow_packet_size_max",
    )


def flow_summary(
    packets: DataFrame, size: Column | None = None, timeout_s: float = TIMEOUT_S
) -> DataFrame:
    """One row per flow session: packets, bytes, duration, rates and size statistics.

    One shuffle on the key, by Spark's session windows. With
    ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` on, a busy key sends one
    partial session per input partition instead of its packets.
    """
    if size is not None:
        packets = packets.withColumn("packet_size", size)
    rows = packets.where(F.col("flow_key").isNotNull()).withColumn("_time", F.timestamp_micros("t_us"))
    gap = f"{round(timeout_s * 1_000_000)} microseconds"
    span = F.greatest(F.lit(0.001), (F.max("t_us") - F.min("t_us")) / 1e6)
    x = F.col("packet_size")
    nth = F.row_number().over(Window.partitionBy("flow_key").orderBy("start_us"))
    return (
        rows.groupBy("flow_key", F.session_window("_time", gap))
        .agg(
            F.min("t_us").alias("start_us"),
            F.max("t_us").alias("end_us"),
            F.count(F.lit(1)).alias("flow_packets"),
            F.sum(x).alias("flow_bytes"),
            span.alias("flow_duration"),
            F.avg(x).alias("flow_packet_size_mean"),
            F.stddev_pop(x).alias("flow_packet_size_std"),
            F.min(x).alias("flow_packet_size_min"),
            F.max(x).alias("flow_packet_size_max"),
        )
        .withColumns(
            {
                "flow_rate_pps": F.col("flow_packets") / F.col("flow_duration"),
                "flow_rate_bps": F.col("flow_bytes") / F.col("flow_duration"),
                "flow_session": nth.cast("bigint"),
            }
        )
        .drop("session_window")
    )
