import math
import random
from collections import Counter

import pytest

from flowlens.operators import flows
from flowlens.operators.features import basic_features, extract_features, with_event_time, with_flow_key

SCHEMA = "packet_id bigint, flow_key string, t_us bigint, packet_size bigint"


def brute_force(rows, timeout_us=60_000_000):
    """Running session statistics by a plain loop over each key's packets in order."""
    out, state = {}, {}
    for pid, key, t, size in sorted(rows, key=lambda r: (r[2], r[0])):
        if key is None:
            out[pid] = (None,) * 5
            continue
        number, sizes, start, last = state.get(key, (0, [], t, None))
        if last is None or t - last > timeout_us:
            number, sizes, start = number + 1, [], t
        sizes = [*sizes, size]
        state[key] = (number, sizes, start, t)
        mean = sum(sizes) / len(sizes)
        sd = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))
        out[pid] = (number, len(sizes), sum(sizes), round(max(0.001, (t - start) / 1e6), 6),
                    round(sd, 6))
    return out


def spark_result(df):
    rows = df.select("packet_id", "flow_session", "flow_packets", "flow_bytes", "flow_duration",
                     "flow_packet_size_std").collect()
    cut = {
        r[0]: tuple(None if v is None else round(v, 6) if isinstance(v, float) else int(v)
                    for v in r[1:])
        for r in rows
    }
    assert len(cut) == len(rows)
    return cut


def test_gap_edges(spark):
    s = 1_000_000
    rows = [
        (1, "a", 0, 10),
        (2, "a", 59_999_999, 20),
        (3, "a", 59_999_999 + 60 * s, 30),  # exactly 60 s later: same session
        (4, "a", 59_999_999 + 120 * s + 1, 40),  # 60.000001 s later: a new one
        (6, "a", 59_999_999 + 120 * s + 1, 60),  # equal time, ordered by packet
        (5, None, 5, 50),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert spark_result(flows.running_flows(df)) == brute_force(rows)
    sliced = flows.running_flows(df, hot_rows=1, slice_s=30.0)
    assert spark_result(sliced) == brute_force(rows)


@pytest.mark.parametrize("seed", range(2))
def test_skewed_flows_equal_brute_force(spark, seed):
    """One key holds a third of all rows; slices of several widths and pauses across them."""
    rng = random.Random(seed)
    rows, t = [], 0
    for pid in range(900):
        t += rng.choice([0, 1, 500_000, 20_000_000, 59_000_000, 61_000_000 if pid % 9 == 0 else 7])
        key = rng.choice(["hot", None, *[f"k{i}" for i in range(25)]]) if pid % 3 else "hot"
        rows.append((pid, key, t, rng.choice([40, 1500, 65535])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_force(rows)
    assert spark_result(flows.running_flows(df)) == want
    for width in (60.0, 1000.0):
        assert spark_result(flows.running_flows(df, hot_rows=100, slice_s=width)) == want


@pytest.mark.parametrize("seed", range(2))
def test_slices_by_rows_equal_brute_force(spark, seed):
    """Bursts, equal times, equal rows and pauses in two busy flows beside small ones and rows without a key."""
    rng = random.Random(seed)
    rows, t = [], -50_000_000
    for pid in range(900):
        t += rng.choice([0, 0, 0, 1, 500_000, 59_000_000, 61_000_000 if pid % 9 == 0 else 7])
        at = t if pid % 5 else 1_000_000  # a fifth of all rows at one instant
        rows.append((pid, rng.choice(["hot", "hot", "warm", None, f"k{pid % 25}"]), at, rng.choice([40, 1500, 65535])))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(5)
    want = brute_force(rows)
    for size in (7, 40, 10_000):
        assert spark_result(flows.running_flows(df, hot_rows=100, slice_rows=size)) == want
    none = flows.running_flows(df.limit(0), hot_rows=0, slice_rows=1)
    assert none.count() == 0


def test_slices_by_rows_are_even(spark):
    """90 % of a flow in one second, half of that at one instant; a second flow of a quarter of the rows."""
    rng = random.Random(3)
    n, size = 40_000, 500
    rows = [(i, "a", 5_000_000 if i % 2 else 5_000_000 + rng.randrange(1_000_000), 40) for i in range(n * 9 // 10)]
    rows += [(i, "a", rng.randrange(10**12), 40) for i in range(n * 9 // 10, n)]
    rows += [(n + i, "b", i, 40) for i in range(n // 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    keys = df.groupBy("flow_key").agg({"*": "count"}).toDF("flow_key", "_rows")
    cut = flows.cut_by_rows(df, keys, size).select("flow_key", "_slice", "t_us", "packet_id").collect()
    per_slice, spans = Counter((r[0], r[1]) for r in cut), {}
    assert len(cut) == len(rows) and max(per_slice.values()) <= 2 * size
    assert len(per_slice) <= 2 * len(rows) / size
    for key, number, t, pid in cut:
        low, high = spans.get((key, number), ((t, pid), (t, pid)))
        spans[key, number] = min(low, (t, pid)), max(high, (t, pid))
    ordered = sorted((k, *v) for k, v in spans.items())
    assert all(a[2] < b[1] for a, b in zip(ordered, ordered[1:], strict=False) if a[0][0] == b[0][0])


def test_open_flows_continue_by_rows(spark):
    """Two batches, the second cut into slices, give what one run over all packets gives."""
    rows = [(i, "ab"[i % 5 == 0], (i // 3) * 9_000_000 + (70_000_000 if i > 70 else 0), 40 + i) for i in range(120)]
    want = brute_force(rows)
    early, late = (spark.createDataFrame(part, SCHEMA) for part in (rows[:60], rows[60:]))
    none = spark.createDataFrame([], flows.OPEN_FLOW)
    first, after = flows.continue_flows(early, none, hot_rows=5, slice_rows=6)
    second, _ = flows.continue_flows(late, after, hot_rows=5, slice_rows=6)
    got = {**spark_result(first), **spark_result(second)}
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}


@pytest.mark.parametrize("options", [{"slice_rows": 2}, {"slice_rows": 100}, {"slice_s": 60.0}, {"slice_s": 1000.0}])
def test_late_packets_behind_an_open_flow(spark, options):
    """Packets before the end of the open session count, and the next pause is measured from that end."""
    s = 1_000_000
    before = spark.createDataFrame([("a", 2, 30, 500, 10, 20, 100 * s, 130 * s)], flows.OPEN_FLOW.replace("decimal(28,0)", "bigint"))
    late = [(9, "a", 20 * s, 5), (10, "a", 115 * s, 7), (11, "a", 190 * s, 9), (12, "a", 251 * s, 11), (13, "a", 252 * s, 1)]
    batch = spark.createDataFrame(late, SCHEMA)
    for hot_rows in (None, 1):
        running, after = flows.continue_flows(batch, before, hot_rows=hot_rows, **options)
        got = {r.packet_id: (r.flow_session, r.flow_packets, r.flow_bytes) for r in running.collect()}
        assert got == {9: (1, 3, 35), 10: (1, 4, 42), 11: (1, 5, 51), 12: (2, 1, 11), 13: (2, 2, 12)}
        end = after.first()
        assert (end["start_us"], end["last_us"], end["packets"], end["low"]) == (251 * s, 252 * s, 2, 1)


def test_summary_agrees_with_the_last_running_row(spark):
    rows = [(i, f"k{i % 3}", i * 25_000_000, 40 + i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for pid, result in sorted(brute_force(rows).items()):
        want[f"k{pid % 3}", result[0]] = result[1:4]
    got = {(r.flow_key, r.flow_session): (r.flow_packets, r.flow_bytes, round(r.flow_duration, 6))
           for r in flows.flow_summary(df).collect()}
    assert got == want


def test_large_sizes_do_not_overflow(spark):
    rows = [(i, "k", i, 2_000_000_000) for i in range(3)]
    last = flows.running_flows(spark.createDataFrame(rows, SCHEMA)).orderBy("packet_id").collect()[-1]
    assert last["flow_packet_size_std"] == 0.0 and last["flow_bytes"] == 6_000_000_000


def test_plan_has_one_exchange_without_hot_keys(spark):
    df = spark.createDataFrame([(i, f"k{i}", i, 40) for i in range(10)], SCHEMA)
    plan = flows.running_flows(df, hot_rows=None)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1


def test_example_packet(spark):
    row = [("192.168.1.1", "192.168.1.2", "tcp", 12345, 80, 100, 1704067200.5, 1)]
    df = spark.createDataFrame(
        row,
        "src_ip string, dst_ip string, protocol string, src_port int, dst_port int, length int, "
        "timestamp double, packet_id bigint",
    )
    assert with_event_time(df).first()["t_us"] == 1704067200500000
    timed = df.withColumn("timestamp", df["timestamp"].cast("timestamp"))
    got = extract_features(timed).first()
    assert got["src_ip_num"] == 3232235777 and got["packet_size"] == 100
    assert got["flow_packets"] == 1 and got["flow_duration"] == 0.001
    assert got["flow_rate_bps"] == 100 / 0.001 and got["flow_packet_size_std"] == 0
    assert (got["time_hour"], got["time_day_of_week"], got["time_is_weekend"]) == (0, 0, 0)
    assert got["protocol_tcp"] == 1 and got["has_payload"] == 0


def test_missing_columns_get_defaults(spark):
    df = basic_features(spark.createDataFrame([(1,)], "packet_id bigint")).first()
    assert (df["src_ip_num"], df["src_port"], df["packet_size"], df["protocol_tcp"]) == (0, 0, 0, 0)
    keyed = with_flow_key(spark.createDataFrame([("1.1.1.1",)], "src_ip string"))
    assert keyed.first()["flow_key"] is None
