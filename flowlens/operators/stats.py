"""Traffic statistics, scan analysis, dashboards and "latest n" views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.filters import syn_only
from flowlens.session import broadcast_if_small, materialized

STAT_DIMENSIONS = ("protocol", "src_ip", "dst_ip", "src_port", "dst_port")

# Registers of a stored port sketch, as a power of two.
SKETCH_BITS = 12


def packet_stats(packets: DataFrame) -> DataFrame:
    """Counts per value of five dimensions and the total, in one pass.

    Rows are ``(dimension, value, n, first_seen)``; NULL, empty text and port 0 are not
    values. Sort with :func:`ranked` for the count-then-first-seen order.
    """
    values = {
        "protocol": F.nullif(F.col("protocol"), F.lit("")),
        "src_ip": F.nullif(F.col("src_ip"), F.lit("")),
        "dst_ip": F.nullif(F.col("dst_ip"), F.lit("")),
        "src_port": F.nullif(F.col("src_port"), F.lit(0)),
        "dst_port": F.nullif(F.col("dst_port"), F.lit(0)),
    }
    narrow = packets.select("packet_id", *[v.alias(k) for k, v in values.items()])
    columns = [F.col(d) for d in STAT_DIMENSIONS]
    counted = narrow.groupingSets([[c] for c in columns] + [[]], *columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("packet_id").alias("first_seen"),
        F.grouping_id().alias("_set"),
    )
    # grouping_id has one bit per dimension, 1 where the dimension is *not* in the set.
    full = 2 ** len(columns) - 1
    dimension = F.lit("total")
    for i, name in enumerate(STAT_DIMENSIONS):
        bit = 2 ** (len(columns) - 1 - i)
        dimension = F.when(F.col("_set") == full - bit, name).otherwise(dimension)
    value = F.coalesce(*[F.col(d).cast("string") for d in STAT_DIMENSIONS])
    rows = counted.select(dimension.alias("dimension"), value.alias("value"), "n", "first_seen")
    return rows.where(F.col("value").isNotNull() | (F.col("dimension") == "total"))


def ranked(stats: DataFrame) -> DataFrame:
    """Display order: by dimension, highest count first, ties in first-seen order."""
    return stats.orderBy("dimension", F.desc("n"), "first_seen")


def syn_scan(packets: DataFrame) -> DataFrame:
    """SYN-without-ACK packets per source."""
    seen = packets.where(syn_only(packets) & _truthy_text("src_ip"))
    return seen.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


def _truthy_text(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def scanned_ports(packets: DataFrame, protocols: tuple[str, ...] = ("tcp", "udp")) -> DataFrame:
    """Distinct ``(protocol, src_ip, dst_ip, dst_port)`` rows.

    The aggregation removes repeats before the shuffle, so a busy pair costs at most one
    row per port and input partition.
    """
    seen = packets.where(
        F.col("protocol").isin(*protocols)
        & _truthy_text("src_ip")
        & _truthy_text("dst_ip")
        & (F.col("dst_port") != 0)
    )
    return seen.select("protocol", "src_ip", "dst_ip", "dst_port").distinct()


def port_scan(packets: DataFrame, protocol: str = "tcp") -> DataFrame:
    """Distinct destination ports per (source, destination), with the sorted port list.

    A list holds 16-bit ports, so it never has more than 65,535 entries.
    """
    return (
        scanned_ports(packets, (protocol,))
        .groupBy("src_ip", "dst_ip")
        .agg(
            F.count(F.lit(1)).alias("n_ports"),
            F.array_sort(F.collect_list("dst_port")).alias("ports"),
        )
    )


def scan_report(packets: DataFrame) -> DataFrame:
    """SYN, TCP-port and UDP-port scan results in one table with a ``kind`` column."""
    ports = (
        scanned_ports(packets)
        .groupBy("protocol", "src_ip", "dst_ip")
        .agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("dst_port")).alias("ports")
        )
        .withColumn("kind", F.when(F.col("protocol") == "tcp", "port_scan").otherwise("udp_scan"))
        .drop("protocol")
    )
    syn = syn_scan(packets).withColumn("kind", F.lit("syn_scan"))
    return ports.unionByName(syn, allowMissingColumns=True)


#: Relative standard error of the port sketch, and how many of them count as doubt.
SKETCH_ERROR, DOUBT = 0.02, 6
#: Pairs in doubt that are broadcast to find their packets.
DOUBTFUL_PAIRS = 100_000


def scan_suspects(packets: DataFrame, threshold: int, protocol: str = "tcp") -> DataFrame:
    """Pairs with ``threshold`` or more distinct ports, by a constant-size sketch.

    ``n_ports`` is exact for the pairs whose sketch is within ``DOUBT`` standard errors of the
    threshold: only their packets are read again and counted. For the others it is the sketch's.
    """
    named = _truthy_text("src_ip") & _truthy_text("dst_ip")
    seen = packets.where((F.col("protocol") == protocol) & named & (F.col("dst_port") != 0))
    pair = ["src_ip", "dst_ip"]
    about = seen.groupBy(*pair).agg(F.approx_count_distinct("dst_port", SKETCH_ERROR).alias("n_ports"))
    high, low = threshold * (1 + DOUBT * SKETCH_ERROR) + 1, threshold * (1 - DOUBT * SKETCH_ERROR) - 1
    about = materialized(about.where(F.col("n_ports") >= low), "suspects")
    doubtful = broadcast_if_small(about.where(F.col("n_ports") < high).select(*pair), DOUBTFUL_PAIRS)
    exact = seen.join(doubtful, pair, "left_semi").groupBy(*pair).agg(F.count_distinct("dst_port").alias("n_ports"))
    return about.where(F.col("n_ports") >= high).unionByName(exact.where(F.col("n_ports") >= threshold))


def port_sketches(packets: DataFrame, width: str = "1 minute", time: str = "timestamp") -> DataFrame:
    """Per window, protocol and pair of addresses the packets and a sketch of the ports tried.

    A sketch is a column of bounded size (some kilobytes, less for few ports), made to be stored:
    :func:`rolled_up` merges those of short windows into long ones without the packets, and
    of any parts of the input, whichever packets they share. Port 0 and NULL count as no port.
    Works on batches and, below a watermark, on streams. Packets without an address
    or a time are left out.
    """
    pair = ["protocol", "src_ip", "dst_ip"]
    seen = packets.where(_truthy_text("src_ip") & _truthy_text("dst_ip") & F.col("protocol").isNotNull())
    port = F.nullif(F.col("dst_port").cast("bigint"), F.lit(0).cast("bigint"))
    made = seen.groupBy(F.window(time, width).alias("_window"), *pair).agg(
        F.count(F.lit(1)).alias("packets"), F.hll_sketch_agg(port, SKETCH_BITS).alias("ports")
    )
    return made.select(F.col("_window.start").alias("window_start"), *pair, "packets", "ports")


def rolled_up(sketches: DataFrame, width: str) -> DataFrame:
    """Stored :func:`port_sketches` merged into longer windows."""
    pair = ["protocol", "src_ip", "dst_ip"]
    made = sketches.groupBy(F.window("window_start", width).alias("_window"), *pair).agg(
        F.sum("packets").alias("packets"), F.hll_union_agg("ports").alias("ports")
    )
    return made.select(F.col("_window.start").alias("window_start"), *pair, "packets", "ports")


def port_counts(sketches: DataFrame) -> DataFrame:
    """The sketches with ``n_ports``, about how many ports each holds: exact for some hundreds at most.

    Beyond that the standard error is 1.04 / sqrt(2 ** ``SKETCH_BITS``), 1.6 %.
    """
    return sketches.withColumn("n_ports", F.hll_sketch_estimate("ports"))


def distinct_ports(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("dst_port") != 0).select("dst_port").distinct()


def operation_timing(timings: DataFrame) -> DataFrame:
    """Count, total, minimum, maximum and average ``duration`` per ``name``."""
    d = F.col("duration")
    return timings.groupBy("name").agg(
        F.count(d).alias("count"),
        F.sum(d).alias("total_duration"),
        F.min(d).alias("min_duration"),
        F.max(d).alias("max_duration"),
        F.avg(d).alias("avg_duration"),
    )


def counters(detections: DataFrame, history: int = 1000) -> DataFrame:
    """Packets processed, alerts generated, and the length of the kept history."""
    n = F.count(F.lit(1))
    return detections.agg(
        n.alias("total_packets_processed"),
        F.count_if("is_alert").alias("total_alerts_generated"),
        F.least(n, F.lit(history)).alias("history_length"),
    )


def dashboard_tiles(detections: DataFrame) -> DataFrame:
    """Totals and rates over detections that carry ``t_us`` and ``packet_size``."""
    n, attacks = F.count(F.lit(1)), F.count_if("is_alert")
    seconds = (F.max("t_us") - F.min("t_us")) / 1e6
    kb = F.sum("packet_size") / 1024
    percent = F.try_divide(attacks * F.lit(100.0), n)
    return detections.agg(
        n.alias("total_packets"),
        attacks.alias("total_alerts"),
        percent.alias("attack_rate_pct"),
        F.try_divide(n.cast("double"), seconds).alias("packets_per_second"),
        kb.alias("total_kb"),
        F.try_divide(kb, seconds).alias("kb_per_second"),
        percent.alias("alert_rate_pct"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column``, such as ``prediction`` or ``protocol``."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def traffic_over_time(df: DataFrame, width: str = "1 minute", slide: str | None = None,
                      timestamp: str = "timestamp") -> DataFrame:
    """Packets, bytes and alerts per tumbling (or sliding) window; batch or stream."""
    bucket = F.window(timestamp, width, slide) if slide else F.window(timestamp, width)
    return (
        df.groupBy(bucket.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.sum("packet_size").alias("bytes"),
            F.count_if("is_alert").alias("alerts"),
        )
        .select(F.col("bucket.start").alias("window_start"), "packets", "bytes", "alerts")
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, n: int | None = 1000, time: str = "t_us", tie: str = "packet_id"):
    """The last ``n`` rows in time order; ``None`` means all, 0 means none."""
    return df if n is None else df.orderBy(F.desc(time), F.desc(tie)).limit(n)


# Up to this many rows per group Spark limits groups before the shuffle by itself
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000
SALTS = 64


def latest_per_key(
    df: DataFrame, key: str, n: int = 100, time: str = "t_us", tie: str = "packet_id"
) -> DataFrame:
    """The last ``n`` rows of every key.

    Spark limits each group before the shuffle (window group limit), so a busy key sends
    at most ``n`` rows per input partition. For a larger ``n`` the rows of a key are first
    ranked within hashed parts, so that one task gets at most ``SALTS * n`` of them.
    """
    latest_first = [F.desc(time), F.desc(tie)]
    if n > GROUP_LIMIT:
        part = Window.partitionBy(key, "_salt").orderBy(*latest_first)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(time, tie), F.lit(SALTS)))
        df = df.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n)
        df = df.drop("_salt", "_rank")
    order = Window.partitionBy(key).orderBy(*latest_first)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def since(df: DataFrame, reset_us: int, time: str = "t_us") -> DataFrame:
    """Rows after a reset: clearing accumulated results is a bound on time."""
    return df.where(F.col(time) >= reset_us)


def append(packets: DataFrame, more: DataFrame) -> DataFrame:
    return packets.unionByName(more, allowMissingColumns=True)


def display_time(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss")


def _shown(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("N/A"))


def packet_table(packets: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Display form of packets."""
    return packets.select(
        "packet_id",
        F.coalesce(display_time(F.col(timestamp)), F.lit("N/A")).alias("time"),
        *[_shown(F.col(c)).alias(c) for c in ("src_ip", "dst_ip", "protocol")],
        F.coalesce(F.nullif(F.col("packet_size"), F.lit(0)).cast("string"), F.lit("N/A")).alias(
            "size"
        ),
    )


def alert_table(detections: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Display form of detections: confidence with four decimals."""
    return detections.select(
        "packet_id",
        F.coalesce(display_time(F.col(timestamp)), F.lit("N/A")).alias("time"),
        *[_shown(F.col(c)).alias(c) for c in ("src_ip", "dst_ip", "protocol", "prediction")],
        F.round("confidence", 4).alias("confidence"),
        F.when(F.col("is_alert"), "alert").otherwise("normal").alias("status"),
    )
