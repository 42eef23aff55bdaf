"""Table schemas and feature groups."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("eth_src_mac", T.StringType()),
        T.StructField("eth_dst_mac", T.StringType()),
        T.StructField("eth_type", T.IntegerType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("ip_protocol", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_ack", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_fin", T.BooleanType()),
        T.StructField("tcp_syn", T.BooleanType()),
        T.StructField("tcp_rst", T.BooleanType()),
        T.StructField("tcp_psh", T.BooleanType()),
        T.StructField("tcp_ack_flag", T.BooleanType()),
        T.StructField("tcp_urg", T.BooleanType()),
        T.StructField("udp_length", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_length", T.IntegerType()),
    ]
)

RAW_FRAME = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("data", T.BinaryType()),
    ]
)

DETECTION = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("is_alert", T.BooleanType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("prediction", T.StringType()),
        T.StructField("actual", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

MODEL = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("model_order", T.IntegerType()),
        T.StructField("path", T.StringType()),
    ]
)

# Feature names and groups, which downstream models depend on.
BASIC_FEATURES = [
    "src_ip_num",
    "dst_ip_num",
    "src_port",
    "dst_port",
    "protocol_tcp",
    "protocol_udp",
    "protocol_icmp",
    "packet_size",
    "has_payload",
]
FLOW_FEATURES = [
    "flow_duration",
    "flow_packets",
    "flow_bytes",
    "flow_rate_pps",
    "flow_rate_bps",
    "flow_packet_size_mean",
    "flow_packet_size_std",
    "flow_packet_size_min",
    "flow_packet_size_max",
]
TIME_FEATURES = [
    "time_hour",
    "time_minute",
    "time_second",
    "time_day_of_week",
    "time_is_weekend",
]
ALL_FEATURES = BASIC_FEATURES + FLOW_FEATURES + TIME_FEATURES

IP_FEATURES = ["src_ip_num", "dst_ip_num"]
CATEGORICAL_FEATURES = [
    "protocol_tcp",
    "protocol_udp",
    "protocol_icmp",
    "has_payload",
    "time_is_weekend",
]
NUMERIC_FEATURES = [
    c for c in ALL_FEATURES if c not in IP_FEATURES and c not in CATEGORICAL_FEATURES
]
