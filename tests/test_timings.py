import pytest
from pyspark.sql import functions as F

from flowlens.operators import stats
from flowlens.operators.timing import TimingLog
from flowlens.sources import files
from flowlens.streaming import timings

SCHEMA = "n bigint"


def deliver(spark, folder, numbers):
    for i in numbers:
        spark.range(10 * (i + 1)).withColumnRenamed("id", "n").coalesce(1).write.parquet(f"{folder}/{i}")


def run(spark, folder, checkpoint, log, keep=timings.KEEP):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    counted = stream.observe("counters", F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") % 2 == 0).alias("even"),
                             F.max(F.lit("text")).alias("word"))
    with timings.recorded(spark, str(log), keep) as recorder:
        writer = counted.writeStream.format("noop").option("checkpointLocation", str(checkpoint))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        recorder.settled(query)
    assert recorder.lost == 0
    return query


def test_one_row_per_batch_and_operation(spark, tmp_path):
    deliver(spark, tmp_path / "in", range(3))
    run(spark, tmp_path / "in", tmp_path / "checkpoint", tmp_path / "log")
    found = timings.progress(spark, str(tmp_path / "log"))
    assert [(r["batch_id"], r["rows"]) for r in found.orderBy("batch_id").collect()] == [(0, 10), (1, 20), (2, 30)]
    rows = timings.operations(found)
    assert rows.groupBy("batch_id", "name").count().where("count > 1").isEmpty()
    rollup = {r["name"]: r for r in stats.operation_timing(rows).collect()}
    assert rollup["addBatch"]["count"] == 3
    assert rollup["triggerExecution"]["total_duration"] >= rollup["addBatch"]["total_duration"] > 0
    seen = {(r["batch_id"], r["counter"]): r["value"] for r in timings.observed_counters(found).collect()}
    assert seen == {(b, c): float(v) for b in range(3) for c, v in (("all", 10 * (b + 1)), ("even", 5 * (b + 1)))}


def test_a_restart_goes_on_in_the_same_table(spark, tmp_path):
    deliver(spark, tmp_path / "in", range(2))
    first = run(spark, tmp_path / "in", tmp_path / "checkpoint", tmp_path / "log")
    deliver(spark, tmp_path / "in", range(2, 4))
    again = run(spark, tmp_path / "in", tmp_path / "checkpoint", tmp_path / "log")
    assert first.id == again.id and first.runId != again.runId
    found = timings.progress(spark, str(tmp_path / "log")).groupBy("query_id").agg(F.sort_array(F.collect_list("batch_id")).alias("b"))
    assert [tuple(r) for r in found.collect()] == [(str(first.id), [0, 1, 2, 3])]


def test_the_table_keeps_the_newest_batches(spark, tmp_path):
    deliver(spark, tmp_path / "in", range(5))
    run(spark, tmp_path / "in", tmp_path / "checkpoint", tmp_path / "log", keep=2)
    found = timings.progress(spark, str(tmp_path / "log"))
    assert sorted(r["batch_id"] for r in found.collect()) == [3, 4]


def test_nothing_recorded_and_streams_that_never_ended(spark, tmp_path):
    assert timings.progress(spark, str(tmp_path / "none")).isEmpty()

    class Unknown:
        runId = "x"

    with pytest.raises(TimeoutError), timings.recorded(spark, str(tmp_path / "none")) as recorder:
        recorder.settled(Unknown(), seconds=0.1)


def test_files_are_replaced_or_stay(spark, tmp_path):
    path = str(tmp_path / "some" / "file.json")
    assert files.put(spark, path, "one")
    assert not files.put(spark, path, "two")
    assert spark.read.text(path).first()[0] == "one"
    assert files.put(spark, path, "three", replace=True)
    assert spark.read.text(path).first()[0] == "three"


def test_a_long_log_holds_few_rows_and_loses_none(spark, tmp_path):
    log = TimingLog(limit=3)
    for i in range(8):
        with log.track("odd" if i % 2 else "even"):
            pass
        assert len(log.rows) < 3
    assert {r["name"]: r["count"] for r in stats.operation_timing(log.table(spark)).collect()} == {"odd": 4, "even": 4}
    path = str(tmp_path / "log")
    log.flush(spark, path)
    assert log.table(spark).isEmpty()
    with log.track("odd"):
        pass
    log.flush(spark, path)
    assert spark.read.json(path).count() == 9
