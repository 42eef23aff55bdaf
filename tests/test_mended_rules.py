"""Cases in which rows were once lost, repeated or read wrongly."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import network
from flowlens.operators import feedback, oversample, quantiles, scoring, stats
from flowlens.plans import training
from flowlens.sources import corpus, tables
from flowlens.streaming import feeds
from flowlens.streaming import flows as stream_flows

FLOW = "packet_id bigint, flow_key string, t_us bigint, packet_size bigint"


def test_a_schema_given_for_one_header_does_not_reach_another(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n7,8\n")
    df, _ = corpus.read_csv_corpus(spark, str(tmp_path), {"x,y": "x int, y int"})
    assert sorted(df.columns) == ["x", "y", "z"]
    assert sorted((r["x"] or 0, r["y"], r["z"] or 0) for r in df.collect()) == [(0, 7, 8), (1, 2, 0)]


def test_columns_of_different_types_are_united(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n1,2\n")
    (tmp_path / "b.csv").write_text("t,n\nBENIGN,2.5\n")
    df, _ = corpus.read_csv_corpus(spark, str(tmp_path))
    assert dict(df.dtypes) == {"n": "double", "t": "string"}
    assert sorted((r["n"], r["t"]) for r in df.collect()) == [(1.0, "2"), (2.5, "BENIGN")]


def test_feedback_of_two_models_on_one_packet_counts_once(spark):
    found = spark.createDataFrame([(1, "attack"), (2, "normal")], "packet_id long, prediction string")
    given = spark.createDataFrame(
        [(1, "m1", 5.0, "attack"), (1, "m2", 9.0, "normal"), (3, "m1", 1.0, "normal"), (2, "m1", 1.0, None)],
        "packet_id long, model_name string, timestamp double, actual string",
    )
    labelled = feedback.with_feedback(found, given)
    assert labelled.count() == 2
    assert tuple(feedback.error_counts(labelled).first()) == (1, 1, 0)


def test_clearing_keeps_feedback_that_came_later(spark, tmp_path):
    schema = ("model_name string, packet_id bigint, timestamp double, features array<double>, "
              "prediction string, actual string, confidence double")  # fmt: skip
    path = f"{tmp_path}/f"
    tables.write_feedback(spark.createDataFrame([("a", 1, 1.0, [1.0], "x", "y", 0.5)], schema), path)
    files = tables.feedback_files(spark, path, "a")
    tables.write_feedback(spark.createDataFrame([("a", 2, 2.0, [1.0], "x", "y", 0.5)], schema), path)
    assert [r["packet_id"] for r in tables.read_feedback(spark, path, "a", files).collect()] == [1]
    assert tables.clear_feedback(spark, path, "a", files)
    assert [r["packet_id"] for r in tables.read_feedback(spark, path).collect()] == [2]


def test_last_training_comes_from_the_stored_metrics(spark, tmp_path):
    one = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)], "accuracy double, precision double, recall double, f1 double")
    for at in (10.0, 30.0):
        tables.append_metrics(one, f"{tmp_path}/m", "a", at)
    assert dict(tables.last_trained(spark, f"{tmp_path}/m").collect()) == {"a": 30.0}


def test_nan_is_a_failed_score(spark):
    df = spark.createDataFrame([(1, math.nan, 0.25), (2, math.nan, math.nan), (3, 0.75, math.nan)], "packet_id long, a double, b double")
    wide = scoring.vote_wide(df, [scoring.Score(F.col("a")), scoring.Score(F.col("b"))])
    assert {r["packet_id"]: r["prediction"] for r in wide.collect()} == {1: "normal", 2: "unknown", 3: "attack"}
    rows = df.select("packet_id", F.posexplode(F.array("a", "b")).alias("model_order", "p_attack"), F.lit(1.0).alias("weight"))
    assert {r["packet_id"]: r["prediction"] for r in scoring.vote_long(rows).collect()} == {1: "normal", 2: "unknown", 3: "attack"}


def test_an_address_ends_with_the_text(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("1.2.3.4\n",), ("::1\n",), ("::1",)], "a string")
    got = df.select(network.is_valid_ip(F.col("a")), network.ip_number(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(True, 16909060.0), (False, 0.0), (False, 0.0), (False, 1.0)]


def test_suspects_have_addresses(spark):
    rows = [(s, d, "tcp", p) for s, d in (("1.1.1.1", "2.2.2.2"), ("1.1.1.1", ""), (None, "2.2.2.2")) for p in range(1, 30)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, protocol string, dst_port int")
    assert [(r["src_ip"], r["dst_ip"]) for r in stats.scan_suspects(df, 10).collect()] == [("1.1.1.1", "2.2.2.2")]


@pytest.mark.parametrize("kept_in_a_table", [False, True])
def test_streams_keep_packets_without_a_flow(spark, tmp_path, kept_in_a_table):
    rows = [(1, "a", 10**15, 5), (2, None, 10**15 + 1, 7), (3, "a", 10**15 + 2, 6)]
    spark.createDataFrame(rows, FLOW).write.parquet(str(tmp_path / "in"))
    packets = spark.readStream.schema(FLOW).parquet(str(tmp_path / "in"))
    if kept_in_a_table:
        query = stream_flows.running_flow_feed(packets, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/ck")
        query.awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out")
        open_flows = spark.read.parquet(f"{tmp_path}/state")
        assert [r["flow_key"] for r in open_flows.collect()] == ["a"]
    else:
        out = feeds.run_available(stream_flows.running_flow_stream(packets), "keyless")
    assert {r["packet_id"]: r["flow_packets"] for r in out.collect()} == {1: 1, 2: None, 3: 2}


def test_quantiles_have_the_same_bits_both_ways(spark):
    df = spark.range(1, 1000).select((F.sin("id") / 3).alias("x"))
    probs = {"x": [0.001, 0.1, 1 / 3, 0.5, 0.77, 0.999]}
    assert quantiles.exact_quantiles(df, probs) == quantiles.exact_quantiles(df, probs, single_task_values=0)


def test_cells_are_halved_and_no_vector_copies_itself(spark):
    rows = [(i, [float(i), float(i * i % 17)], 0 if i < 300 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    made = oversample.balance_classes(df, "label", cell_rows=16).where("synthetic").collect()
    real = {tuple(r[1]) for r in rows}
    assert len(made) == 200 and all(tuple(r["features"]) not in real for r in made)
    again = oversample.balance_classes(df.repartition(7), "label", cell_rows=16).where("synthetic").collect()
    assert sorted(tuple(r["features"]) for r in made) == sorted(tuple(r["features"]) for r in again)


def test_a_corpus_with_dates_and_dotted_names(spark):
    rows = [(f"2020-01-{1 + i % 9:02}", float(i), i % 2 == 0, "BENIGN" if i % 3 else "DoS") for i in range(120)]
    df = spark.createDataFrame(rows, "day string, `Flow.Bytes/s` double, fwd boolean, Label string")
    df = df.withColumn("day", F.to_date("day")).withColumn("at", F.col("day").cast("timestamp"))
    one = training.prepare(df, balance=False)
    assert one.features == ["day", "Flow.Bytes/s", "fwd", "at"]
    two = training.prepare(df.repartition(5), balance=False)
    parts = [sorted((tuple(round(x, 9) for x in r["features"]), r["label"], r["split"]) for r in p.rows.collect()) for p in (one, two)]
    assert parts[0] == parts[1] and len(parts[0]) == 120
