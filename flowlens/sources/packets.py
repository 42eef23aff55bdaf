"""Packet readers and writers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.stats import append, latest
from flowlens.schemas import PACKET, RAW_FRAME

BUFFER = 1_000
# Spark's own JSON format keeps milliseconds only.
TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def default_name(now: datetime) -> str:
    return now.strftime("packets_%Y%m%d_%H%M%S.json")


def write_packets(packets: DataFrame, path: str, fmt: str = "json", by_date: bool = False) -> None:
    """Packets without raw bytes; ``by_date`` partitions the folder for pruned reads."""
    out = packets.drop("data", "payload")
    writer = out.write
    if by_date:
        out = out.withColumn("date", F.to_date("timestamp"))
        writer = out.write.partitionBy("date")
    if fmt == "json":
        writer = writer.option("timestampFormat", TIMESTAMPS)
    writer.mode("overwrite").format(fmt).save(path)


def read_packets(spark: SparkSession, path: str, fmt: str = "json", multi_line: bool = False):
    """Packet table with the declared schema; ``multi_line`` reads one JSON array per file."""
    reader = spark.read.schema(PACKET)
    if fmt == "json":
        reader = reader.options(multiLine=multi_line, timestampFormat=TIMESTAMPS)
    return reader.format(fmt).load(path)


def load_into(packets: DataFrame, more: DataFrame, keep: int | None = None) -> DataFrame:
    """Append loaded packets; ``keep`` trims to the newest rows (the classic buffer: 1,000)."""
    return latest(append(packets, more), keep, time="timestamp")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_FRAME).parquet(path)


def stream_packets(
    spark: SparkSession, path: str, fmt: str = "json", schema=PACKET, **options
) -> DataFrame:
    """Packets arriving as files in a folder; options such as maxFilesPerTrigger pass through."""
    if fmt == "json":
        options = {"timestampFormat": TIMESTAMPS} | options
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def stream_packets_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Packets as JSON messages; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    raw = raw.option("subscribe", topic).load()
    parsed = F.from_json(F.col("value").cast("string"), PACKET, {"timestampFormat": TIMESTAMPS})
    return raw.select(parsed.alias("packet")).select("packet.*")
