import pytest
from test_flows import SCHEMA, brute_force, spark_result

from flowlens.operators import flows
from flowlens.streaming import feeds
from flowlens.streaming import flows as stream_flows

S = 1_000_000


def files(spark, folder, parts):
    """One parquet file per part, to be read one per micro-batch in order."""
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/{i}")
    return (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


PARTS = [
    [(1, "a", 0, 10), (2, "b", 5 * S, 20), (3, "a", 59 * S, 30)],
    [(4, "a", 119 * S, 40), (5, "a", 119 * S, 50), (6, "b", 120 * S, 60)],
    [(7, "a", 179 * S + 1, 70), (8, "b", 180 * S, 80), (9, "c", 180 * S, 90)],
]
# Not at the epoch itself, where Spark's first watermark lies.
BASE = 1_700_000_000 * S
PARTS = [[(pid, key, BASE + t, size) for pid, key, t, size in part] for part in PARTS]
ROWS = [r for part in PARTS for r in part]


def without_session(result):
    return {pid: values[1:] for pid, values in result.items()}


def feed(spark, stream, tmp_path, **options):
    query = stream_flows.running_flow_feed(
        stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/checkpoint", **options
    )
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_feed_over_several_batches_equals_batch(spark, tmp_path):
    out = feed(spark, files(spark, tmp_path / "in", PARTS), tmp_path)
    assert out.select("batch").distinct().count() == 3
    assert without_session(spark_result(out)) == without_session(brute_force(ROWS))
    left = spark.read.parquet(f"{tmp_path}/state/batch=2")
    assert {r["flow_key"] for r in left.collect()} == {"a", "b", "c"}


def test_feed_with_hot_flows_equals_batch(spark, tmp_path):
    out = feed(spark, files(spark, tmp_path / "in", PARTS), tmp_path, hot_rows=1)
    assert without_session(spark_result(out)) == without_session(brute_force(ROWS))


def test_state_store_over_several_batches_equals_batch(spark, tmp_path):
    stream = stream_flows.running_flow_stream(files(spark, tmp_path / "in", PARTS))
    out = feeds.run_available(stream, "state")
    got = {r["packet_id"]: (r["flow_packets"], r["flow_bytes"], round(r["flow_duration"], 6),
                            round(r["flow_packet_size_std"], 6)) for r in out.collect()}
    assert got == without_session(brute_force(ROWS))


def test_late_packet_is_counted_but_does_not_move_the_end(spark):
    before = spark.createDataFrame(
        [("a", 2, 30, 500, 10, 20, 100 * S, 130 * S)],
        "flow_key string, packets bigint, bytes bigint, squares bigint, low bigint, high bigint, "
        "start_us bigint, last_us bigint",
    )
    batch = spark.createDataFrame([(9, "a", 120 * S, 5), (10, "a", 190 * S, 7)], SCHEMA)
    for hot_rows in (None, 1):
        running, after = flows.continue_flows(batch, before, hot_rows=hot_rows)
        got = {r["packet_id"]: (r["flow_packets"], r["flow_bytes"], r["flow_duration"])
               for r in running.collect()}
        assert got == {9: (3, 35, 30.0), 10: (4, 42, 90.0)}
        end = after.first()
        assert (end["last_us"], end["packets"], end["low"], end["start_us"]) == (190 * S, 4, 5, 100 * S)


def test_state_function_with_a_late_packet():
    import pandas as pd

    batch = pd.DataFrame({"packet_id": [9], "t_us": [120 * S], "packet_size": [5]})
    out, state = stream_flows._advance(batch, (2, 30, 500, 10, 20, 100 * S, 130 * S), 60 * S)
    assert out["flow_packets"][0] == 3 and out["flow_duration"][0] == 30.0
    assert state[-1] == 130 * S and state[0] == 3


def test_closed_flows(spark, tmp_path):
    parts = [*PARTS, [(10, "d", BASE + 1000 * S, 1)]]
    stream = stream_flows.closed_flow_stream(files(spark, tmp_path / "in", parts))
    out = feeds.run_available(stream, "closed").collect()
    got = sorted((r["flow_key"], r["start_us"], r["end_us"], r["flow_packets"]) for r in out)
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted((r["flow_key"], r["start_us"], r["end_us"], r["flow_packets"])
                  for r in flows.flow_summary(df).collect())
    assert got == want


def test_duplicates_across_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    parts = [PARTS[0], [*PARTS[0][:1], *PARTS[1]]]
    stream = files(spark, tmp_path / "in", parts).withColumn("timestamp", F.timestamp_micros("t_us"))
    out = feeds.run_available(feeds.without_duplicates(stream), "once")
    assert sorted(r["packet_id"] for r in out.collect()) == [1, 2, 3, 4, 5, 6]


def test_closed_and_open_flows_are_all_flows(spark, tmp_path):
    """Late and repeated packets, one behind the watermark, a restart, and flows without sizes."""
    size_free = (11, "e", BASE + 175 * S, None)
    parts = [
        [PARTS[0][0], *PARTS[0][2:]],
        [PARTS[0][1], *PARTS[1]],  # packet 2 comes late
        [*PARTS[2], PARTS[0][2], PARTS[2][1], size_free],  # packets 3 and 8 come again
        [(12, "d", BASE + 2000 * S, 5)],
        [(13, "a", BASE + 1 * S, 5), (14, "d", BASE + 2030 * S, 7)],  # packet 13 is too late
    ]
    path, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for i in range(len(parts)):
        stream = files(spark, tmp_path / "in", [parts[i]] if i else parts[:1])
        closing = stream_flows.closed_flow_stream(stream, delay="300 seconds", repeated=True)
        closed = feeds.run_available(closing, "closed", path=path, checkpoint=checkpoint)
        got = closed.unionByName(stream_flows.open_flows(spark, checkpoint))
        seen = {r[0]: r for part in parts[: i + 1] for r in part if r[0] != 13}
        want = flows.flow_summary(spark.createDataFrame(list(seen.values()), SCHEMA))
        columns = sorted(got.columns)
        assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert closed.count() and stream_flows.open_flows(spark, checkpoint).count() == 1


def test_open_flows_of_another_stream_are_refused(spark, tmp_path):
    from pyspark.sql import functions as F

    timed = files(spark, tmp_path / "in", PARTS).withColumn("time", F.timestamp_micros("t_us"))
    once = feeds.without_duplicates(timed, "time")
    checkpoint = f"{tmp_path}/checkpoint"
    feeds.run_available(once, "once", checkpoint=checkpoint)
    with pytest.raises(ValueError, match="no sessions"):
        stream_flows.open_flows(spark, checkpoint)


def test_port_sketches_of_a_stream_equal_those_of_all_packets(spark, tmp_path):
    from pyspark.sql import functions as F

    from flowlens.operators import stats

    schema = "packet_id bigint, t_us bigint, protocol string, src_ip string, dst_ip string, dst_port bigint"
    rows = [
        (i, BASE + i * S // 2, "tcp", "a", "b" if i % 3 else "c", [80, 0, None, 5_000 + i % 400][i % 4]) for i in range(4_000)
    ]
    rows += [(5_000, BASE, "tcp", None, "b", 1), (5_001, BASE, None, "a", "b", 1)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    timed = reader.parquet(f"{tmp_path}/in").withColumn("timestamp", F.timestamp_micros("t_us"))
    changes = feeds.run_available(stats.port_sketches(timed.withWatermark("timestamp", "1 hour")), "sketches", mode="update")
    newest = changes.groupBy("window_start", "protocol", "src_ip", "dst_ip").agg(F.max_by(F.struct("packets", "ports"), "batch").alias("x"))
    newest = newest.select("window_start", "protocol", "src_ip", "dst_ip", "x.*")
    batch = spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_micros("t_us"))

    def hours(sketches):
        counted = stats.port_counts(stats.rolled_up(sketches, "1 hour")).drop("ports")
        return sorted(map(repr, counted.collect()))

    assert hours(newest) == hours(stats.port_sketches(batch))
    exact = {}
    for _, t, protocol, src, dst, port in rows:
        if src and protocol and port:
            exact.setdefault((t // (3600 * S), dst), set()).add(port)
    got = {r["dst_ip"]: r["n_ports"] for r in stats.port_counts(stats.rolled_up(newest, "1 day")).collect()}
    assert sum(got.values()) == sum(len(set().union(*[p for (_, d), p in exact.items() if d == dst])) for dst in ("b", "c"))
