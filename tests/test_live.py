"""Live detection by published models against the batch job."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from flowlens.operators.features import extract_features
from flowlens.operators.prep import Preprocessor
from flowlens.plans.detection import score_and_vote
from flowlens.session import work_path
from flowlens.sources import files, versions
from flowlens.streaming import live

SCHEMA = "packet_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_size long"


def packets(n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], 1_704_067_200_000_000
    for i in range(n):
        t += rng.choice([0, 1000, 2_000_000, 9_000_000])
        a, b = (f"10.0.0.{rng.randrange(4)}", "192.168.1.1")
        a, b = (a, b) if rng.random() < 0.6 else (b, a)
        rows.append((i, t, None if i % 50 == 7 else a, b, 1000, 80, rng.choice(["tcp", "tcp", "udp"]), rng.randrange(40, 1500)))
    return rows


def fixed_model(expression):
    score = SQLTransformer(statement=f"select *, 1 - _q as _q0 from (select *, {expression} as _q from __THIS__) t")
    return PipelineModel(stages=[score, VectorAssembler(inputCols=["_q0", "_q"], outputCol="probability")])


MODELS = [("a", "0.5 + 0.5 * packet_size / (1 + abs(packet_size))", 1.0), ("b", "0.5 - 0.4 * flow_packets / (1 + abs(flow_packets))", 0.5)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.timestamp_micros("t_us"))


def written(spark, rows, cuts):
    """The rows as files of a folder, in the order of time, shuffled within a file."""
    path = work_path(spark, "live-packets")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        own = rows[a:b]
        random.Random(a).shuffle(own)
        table(spark, own).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = table(spark, packets(1)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def feed(spark, source, preprocessor, folder, names, **options):
    query = live.live_feed(stream(spark, source), preprocessor, folder, names[0], names[1], names[2], **options)
    query.awaitTermination()


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.fixture(scope="module")
def published(spark):
    folder = work_path(spark, "live-models")
    for place, (name, expression, weight) in enumerate(MODELS):
        versions.publish(fixed_model(expression), folder, name, weight=weight, place=place)
    return folder


@pytest.mark.parametrize(("cuts", "options"), [([], {}), ([90, 91, 250], {}), ([200], {"held_rows": 20, "slice_us": 5_000_000})])
def test_live_detections_equal_the_batch_job(spark, published, cuts, options):
    rows = packets()
    batch = table(spark, rows)
    fitted = Preprocessor.fit(extract_features(batch))
    models = [(n, fixed_model(e), w) for n, e, w in MODELS]
    want = score_and_vote(batch, fitted, models)
    names = [work_path(spark, f"live-{x}") for x in ("detections", "alerts", "checkpoint")]
    feed(spark, written(spark, rows, cuts), fitted, published, names, **options)
    got = spark.read.parquet(names[0])
    assert got.select("batch").distinct().count() == len(cuts) + 1
    assert rows_of(got.drop("batch")) == rows_of(want)
    assert rows_of(spark.read.parquet(names[1]).drop("batch")) == rows_of(want.where("is_alert"))
    assert 0 < want.where("is_alert").count() < want.count()


def test_a_packet_dated_ahead_closes_no_other_flow(spark, published):
    rows = packets(200)
    ahead = (9_000, rows[0][1] + 86_400_000_000, "10.9.9.9", "192.168.1.1", 1, 80, "tcp", 100)
    rows = [*rows[:60], ahead, *rows[60:]]
    batch = table(spark, rows)
    fitted = Preprocessor.fit(extract_features(batch))
    want = score_and_vote(batch, fitted, [(n, fixed_model(e), w) for n, e, w in MODELS])
    names = [work_path(spark, f"ahead-{x}") for x in ("detections", "alerts", "checkpoint")]
    feed(spark, written(spark, rows, [61, 130]), fitted, published, names)
    assert rows_of(spark.read.parquet(names[0]).drop("batch")) == rows_of(want)


@pytest.mark.parametrize(("keep_s", "second"), [(live.KEEP_S, [(2, 3), (3, 4)]), (-1.0, [(2, 1), (3, 2)])])
def test_a_silent_flow_is_forgotten_by_a_timer(spark, keep_s, second):
    """The timer of a flow that is not to be kept has fired before its next micro-batch."""
    rows = [(i, 1_704_067_200_000_000 + i * 1_000_000, "1.1.1.1", "2.2.2.2", 1, 2, "tcp", 100) for i in range(4)]
    seen = []

    def keep(batch, number):
        seen.append(sorted((r.packet_id, r.flow_packets) for r in batch.collect()))

    path, checkpoint = written(spark, rows[:2], []), work_path(spark, "silent")
    spark.conf.set(live.PROVIDER, live.ROCKSDB)
    try:
        for more in (None, rows[2:]):
            if more:
                table(spark, more).coalesce(1).write.mode("append").parquet(path)
            features = live.live_features(stream(spark, path), keep_s=keep_s)
            query = features.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
            query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(live.PROVIDER)
    assert [x for x in seen if x] == [[(0, 1), (1, 2)], second]


def test_versions_are_whole_and_append_only(spark):
    folder = work_path(spark, "versions")
    assert versions.newest(spark, folder) == []
    one = versions.publish(fixed_model("0.75"), folder, "m", weight=0.5, place=3, labels=["normal", "attack"], at_s=10.0)
    choice = f"{folder}-choices/batch-0.json"
    assert versions.choose(spark, folder, choice) == [one]
    two = versions.publish(fixed_model("0.25"), folder, "m", at_s=20.0)
    assert (two.version, two.weight, two.place, two.labels) == (2, 0.5, 3, ["normal", "attack"])
    assert versions.newest(spark, folder) == [two]
    assert versions.choose(spark, folder, choice) == [one]  # a repeat uses what the first try used
    assert versions.manifest(spark, folder).count() == 2
    assert not files.put(spark, f"{folder}/{versions.MANIFEST}/m-000002.json", "{}")
    loaded = versions.Loaded()
    assert [v.version for v, _ in loaded.get([one])] == [1]
    assert loaded.get([one])[0][1] is loaded.models[one.path]
    loaded.get([two])
    assert list(loaded.models) == [two.path]


def test_equal_results_after_a_restart_in_the_middle(spark, published):
    rows = packets(300, seed=4)
    batch = table(spark, rows)
    fitted = Preprocessor.fit(extract_features(batch))
    want = score_and_vote(batch, fitted, [(n, fixed_model(e), w) for n, e, w in MODELS])
    names = [work_path(spark, f"restart-{x}") for x in ("detections", "alerts", "checkpoint")]
    path = written(spark, rows[:170], [60])

    def fail(number):
        if number == 1:
            raise RuntimeError("lost after the second micro-batch was written")

    with pytest.raises(Exception, match="lost after"):
        feed(spark, path, fitted, published, names, after_batch=fail)
    table(spark, rows[170:]).coalesce(1).write.mode("append").parquet(path)
    feed(spark, path, fitted, published, names)
    assert rows_of(spark.read.parquet(names[0]).drop("batch")) == rows_of(want)


def test_retraining_publishes_or_leaves_the_version_before(spark):
    from flowlens.plans.retraining import retrain_if_due
    from flowlens.sources import tables

    folder, feedback = work_path(spark, "retrain-models"), work_path(spark, "retrain-feedback")
    one = versions.publish(fixed_model("0.75"), folder, "m", weight=0.5, at_s=0.0)
    rng = random.Random(1)
    rows = []
    for i in range(90):
        label = ("normal", "attack", "probe")[i % 3]
        rows.append(("m", i, float(i), [float(i % 3) + rng.random() / 2, rng.random()], "normal", label, 0.5))
    entries = spark.createDataFrame(rows, "model_name string, packet_id long, timestamp double, features array<double>, prediction string, actual string, confidence double")
    small = {"trees": [3], "depths": [3], "folds": 2}

    def attempt(now, **grid):
        return retrain_if_due(spark, "m", feedback, folder, now, ["x", "y"], **(small | grid))

    assert attempt(4000.0).reason == "no feedback"
    tables.write_feedback(entries.limit(5), feedback)
    assert attempt(4000.0).reason == "5 usable entries"
    tables.write_feedback(entries, feedback, mode="replace")
    assert attempt(100.0).reason == "too soon"
    failed = attempt(4000.0, depths=[99])  # deeper than a forest can be
    assert failed.version is None and failed.reason
    assert versions.newest(spark, folder) == [one] and tables.feedback_files(spark, feedback, "m")
    done = attempt(4000.0)
    assert (done.version.version, done.version.labels, done.version.weight) == (2, ["normal", "attack", "probe"], 0.5)
    assert not tables.feedback_files(spark, feedback, "m")
    (_, model), = versions.Loaded().get([done.version])
    scored = model.transform(spark.createDataFrame([(0.2, 0.5), (1.2, 0.5), (2.2, 0.5)], "x double, y double"))
    assert [r.prediction for r in scored.collect()] == [0.0, 1.0, 2.0]
    from flowlens.operators.scoring import attack_probability

    shares = [r[0] for r in scored.select(attack_probability("probability", 3)).collect()]
    assert shares[0] < 0.5 < min(shares[1:])


def test_many_flows_are_advanced_in_one_call():
    """A group's flows in one call as each on its own, over several batches, with pauses and late packets."""
    import numpy as np
    import pandas as pd

    from flowlens.streaming import flows

    rng = random.Random(5)
    S = 1_000_000
    whole, alone = flows.open_table(None), {}
    for number in range(4):
        rows = [(rng.choice("abcdef"), i, number * 60 * S + rng.randrange(90) * S, rng.choice([0, 40, 1500, 3_000_000_000])) for i in range(60)]
        batch = pd.DataFrame(rows, columns=["flow_key", "packet_id", "t_us", "packet_size"])
        out, whole = flows.advance_flows(batch, whole, 60 * S)
        assert (batch["packet_id"].to_numpy()[out.index] == out["packet_id"]).all()
        for key, own in batch.groupby("flow_key"):
            want, alone[key] = flows._advance(own.reset_index(drop=True), alone.get(key), 60 * S)
            got = out[out["flow_key"] == key]
            for c in want.columns.drop("flow_key"):
                assert np.array_equal(got[c], want[c], equal_nan=True), c
    keys, *columns = flows.state_row(whole)
    assert {k: v for k, *v in zip(keys, *columns, strict=True)} == {k: list(v) for k, v in alone.items()}


def test_one_call_takes_many_flows(spark):
    """The number of groups, and of Python calls, doesn't grow with the flows."""
    from flowlens.streaming import flows

    keys = spark.range(50_000).select(F.col("id").cast("string").alias("k"))
    assert keys.select(flows.flow_group("k")).distinct().count() <= flows.FLOW_GROUPS < 50_000
