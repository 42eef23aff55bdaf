"""Round trips through the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import evaluation, stats
from flowlens.operators.timing import TimingLog
from flowlens.plans.catalogue import query
from flowlens.plans.catalogue.detecting import WITH_FEEDBACK, feedback_entries, voted
from flowlens.plans.catalogue.features import rounded
from flowlens.plans.views import WITH_PACKETS, WITH_VOTES, packets, table
from flowlens.session import materialized, work_path
from flowlens.sources import corpus, models, tables
from flowlens.sources import packets as packet_files

PACKET_SQL = """packet_id, src_ip, dst_ip, cast(src_port as integer) as src_port,
  cast(dst_port as integer) as dst_port, protocol, cast(packet_size as integer) as length"""


def stored_packets(spark, folder):
    """Packets in the declared schema, with bytes that a writer has to leave out."""
    return packets(spark, folder).select(
        "packet_id",
        F.timestamp_micros("t_us").alias("timestamp"),
        F.col("event_type").cast("binary").alias("data"),
        F.col("packet_size").cast("int").alias("length"),
        "src_ip",
        "dst_ip",
        F.col("src_port").cast("int").alias("src_port"),
        F.col("dst_port").cast("int").alias("dst_port"),
        "protocol",
    )


@query("packet_json", f"{WITH_PACKETS} select {PACKET_SQL}, t_us, true as no_data from packets")
def packet_json(spark, folder):
    path = work_path(spark, "packets-json")
    packet_files.write_packets(stored_packets(spark, folder), path)
    back = packet_files.read_packets(spark, path)
    return back.select(
        "packet_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length",
        F.unix_micros("timestamp").alias("t_us"), F.col("data").isNull().alias("no_data"),
    )


@query("packet_parquet_by_date",
       f"{WITH_PACKETS} select protocol, count(*) as n from packets group by protocol")
def packet_parquet_by_date(spark, folder):
    path = work_path(spark, "packets-parquet")
    packet_files.write_packets(stored_packets(spark, folder), path, fmt="parquet", by_date=True)
    return stats.distribution(spark.read.parquet(path), "protocol")


@query("load_into_buffer", f"{WITH_PACKETS} select packet_id, src_ip from packets "
       "order by t_us desc, packet_id desc limit 1000")  # fmt: skip
def load_into_buffer(spark, folder):
    df = stored_packets(spark, folder)
    path = work_path(spark, "packets-more")
    packet_files.write_packets(df.where("protocol <> 'tcp'"), path)
    more = packet_files.read_packets(spark, path)
    kept = packet_files.load_into(df.where("protocol = 'tcp'"), more, keep=packet_files.BUFFER)
    return kept.select("packet_id", "src_ip")


@query("csv_union", """select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 2 then l_quantity
  end as l_quantity, case when l_linenumber % 3 <> 1 then l_returnflag end as l_returnflag,
  1::bigint as skipped_files, cast(null as varchar) as broken_row from lineitem
  union all select -1, -1, 7, null, 1, '7.0,-1,-1,more'""")
def csv_union(spark, folder):
    """CSV files with three headers, one empty file and one row too long, columns united by name."""
    lines = table(spark, folder, "lineitem")
    path = work_path(spark, "corpus")
    headers = [
        ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"],
        ["l_quantity", "l_orderkey", "l_linenumber"],
        ["l_returnflag", "l_linenumber", "l_orderkey"],
    ]
    for i, names in enumerate(headers):
        part = lines.where(F.col("l_linenumber") % 3 == i).select(*names)
        part.write.mode("append").csv(path, header=True)
    _add_file(spark, f"{path}/empty.csv", "")  # as left by a broken download
    _add_file(spark, f"{path}/long.csv", "l_quantity,l_orderkey,l_linenumber\n7.0,-1,-1,more\n")
    df, skipped = corpus.read_csv_corpus(spark, path, broken="broken_row")
    return df.select(
        F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"),
        F.col("l_quantity").cast("double"), "l_returnflag",
        F.lit(skipped.count()).cast("bigint").alias("skipped_files"), "broken_row",
    )


def _add_file(spark, path, text):
    """A file of given text among the corpus files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(target)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


@query("feedback_store", f"""{WITH_FEEDBACK} select model_name, packet_id, prediction, actual,
  2 as n_features from feedback where model_name = 'm1' or actual = 'attack'""")
def feedback_store(spark, folder):
    """Saved per model, then one model's rows replaced."""
    entries = feedback_entries(spark, folder)
    path = work_path(spark, "feedback")
    tables.write_feedback(entries, path)
    newer = entries.where("model_name = 'm2' and actual = 'attack'")
    tables.write_feedback(newer, path, mode="replace")
    tables.write_feedback(entries.where("model_name = 'm3'"), path)
    back = tables.read_feedback(spark, path)
    return back.select("model_name", "packet_id", "prediction", "actual",
                       F.size("features").alias("n_features"))


@query("feedback_cleared",
       f"{WITH_FEEDBACK} select model_name, count(*) as n from feedback "
       "where model_name = 'm2' group by model_name")  # fmt: skip
def feedback_cleared(spark, folder):
    path = work_path(spark, "feedback")
    tables.write_feedback(feedback_entries(spark, folder), path)
    tables.clear_feedback(spark, path, "m1")
    return tables.read_feedback(spark, path).groupBy("model_name").agg(F.count("*").alias("n"))


@query("timing_store", """select event_type as name, count(*) as count, min(value) as min_duration,
  max(value) as max_duration from events group by event_type""")
def timing_store(spark, folder):
    timings = table(spark, folder, "events").select(
        F.col("event_type").alias("name"), F.col("value").alias("duration")
    )
    path = work_path(spark, "timings")
    tables.write_timings(stats.operation_timing(timings), path)
    schema = "name string, count bigint, min_duration double, max_duration double"
    return spark.read.schema(schema).json(path)


@query("timed_operations", f"""{WITH_PACKETS} select 'write_udp' as name, 2 as count,
  true as timed, count(*) as n from packets where protocol = 'udp' union all
  select 'write_' || protocol, 1, true, count(*) from packets where protocol in ('tcp', 'icmp') group by protocol""")
def timed_operations(spark, folder):
    """Four writes timed, logged, rolled up, next to the rows they wrote."""
    log, df = TimingLog(), packets(spark, folder)
    out, path = work_path(spark, "timed"), work_path(spark, "timing-log")
    for protocol in ("udp", "tcp", "icmp", "udp"):
        with log.track(f"write_{protocol}"):
            part = df.where(F.col("protocol") == protocol)
            part.write.mode("overwrite").parquet(f"{out}/name=write_{protocol}")
    log.flush(spark, path)
    stored = spark.read.schema("name string, duration double").json(path)
    rollup = stats.operation_timing(stored).select(
        "name", F.col("count").cast("int").alias("count"),
        (F.col("total_duration") > 0).alias("timed"),
    )
    written = spark.read.parquet(out).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return rollup.join(written, "name")


@query("metrics_history", f"""{WITH_VOTES} select 'vote' as model_name, cast(k as double)
  as evaluated_at, round(avg(case when label = prediction then 1e0 else 0e0 end), 6) as accuracy
  from detections, (values (1), (2)) t(k) where k = 1 or protocol = 'tcp' group by k""")
def metrics_history(spark, folder):
    path = work_path(spark, "metrics")
    df = voted(spark, folder)
    tables.append_metrics(evaluation.evaluate(df), path, "vote", 1)
    tables.append_metrics(evaluation.evaluate(df.where("protocol = 'tcp'")), path, "vote", 2)
    history = tables.metrics_history(spark, path)
    return rounded(history.select("model_name", "evaluated_at", "accuracy"), ["accuracy"])


@query("model_store")
def model_store(spark, folder):
    """Two pipelines fitted on the packets, saved, loaded with a registry, and voting."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    from flowlens.operators.prep import Preprocessor
    from flowlens.plans.detection import score_and_vote
    from flowlens.plans.training import feature_pipeline
    from flowlens.operators.features import extract_features

    df = packets(spark, folder).withColumn("timestamp", F.timestamp_micros("t_us"))
    features = materialized(extract_features(df, keep=("packet_id", "label")), "features")
    prepared = Preprocessor.fit(features.drop("label"))
    rows = prepared.transform(features)
    rows = rows.withColumn("target", F.when(F.col("label") == "attack", 1.0).otherwise(0.0))
    path = work_path(spark, "models")
    kinds = {
        "tree": DecisionTreeClassifier(labelCol="target", maxDepth=4, seed=42),
        "logit": LogisticRegression(labelCol="target", maxIter=5),
    }
    for name, kind in kinds.items():
        fitted = feature_pipeline(prepared.output_columns(), kind).fit(rows)
        models.save_model(fitted, path, name)
    loaded, registry, _ = models.load_models(spark, path)
    weights = {r["model"]: r["weight"] for r in registry.collect()}
    members = [(name, model, weights[name]) for name, model in loaded.items()]
    return score_and_vote(df, prepared, members)
