"""Frame decoding: raw bytes to packet columns, all in built-in binary expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import binary as B
from flowlens.session import computed_once

# Fixed values of the wire formats.
ETHERNET_HEADER = 14
ETHERTYPE_IPV4 = 0x0800
IP_HEADER = 20
TCP_HEADER = 20
UDP_HEADER = 8
PROTO_TCP = 6
PROTO_UDP = 17
TCP_FLAG_BITS = {
    "tcp_fin": 0x01,
    "tcp_syn": 0x02,
    "tcp_rst": 0x04,
    "tcp_psh": 0x08,
    "tcp_ack_flag": 0x10,
    "tcp_urg": 0x20,
}


def decode_ethernet(frames: DataFrame) -> DataFrame:
    """MAC addresses and type; a frame shorter than the header keeps NULLs."""
    header = F.col("_eth")
    read = frames.withColumn("_eth", B.header_hex(F.col("data"), 0, ETHERNET_HEADER))
    return read.withColumns(
        {
            "eth_src_mac": B.mac_text(header, 6),
            "eth_dst_mac": B.mac_text(header, 0),
            "eth_type": B.unsigned(header, 12, 2),
        }
    ).drop("_eth")


def decode_ip(frames: DataFrame, offset: int = ETHERNET_HEADER) -> DataFrame:
    """IPv4 fields plus ``_l4``, the byte offset of the transport header.

    With an ``eth_type`` column present only IPv4 frames are read.
    """
    header = F.col("_ip")
    text = B.header_hex(F.col("data"), offset, IP_HEADER)
    if "eth_type" in frames.columns:
        text = F.when(F.col("eth_type") == ETHERTYPE_IPV4, text)
    version_ihl = B.unsigned(header, 0, 1)
    return (
        computed_once(frames, {"_ip": text})
        .withColumns(
            {
                "ip_version": F.shiftright(version_ihl, 4),
                "ip_protocol": B.unsigned(header, 9, 1),
                "src_ip": B.ipv4_text(header, 12),
                "dst_ip": B.ipv4_text(header, 16),
                "_l4": version_ihl.bitwiseAND(15) * 4 + offset,
            }
        )
        .drop("_ip")
    )


def decode_transport(packets: DataFrame) -> DataFrame:
    """TCP and UDP fields of the output of :func:`decode_ip`."""
    data, start = F.col("data"), F.col("_l4")
    read = computed_once(
        packets,
        {
            "_tcp": F.when(
                F.col("ip_protocol") == PROTO_TCP, B.header_hex(data, start, TCP_HEADER)
            ),
            "_udp": F.when(
                F.col("ip_protocol") == PROTO_UDP, B.header_hex(data, start, UDP_HEADER)
            ),
        },
    )
    tcp, udp = F.col("_tcp"), F.col("_udp")
    either = F.coalesce(tcp, udp)
    tcp_body = start + F.shiftright(B.unsigned(tcp, 12, 1), 4) * 4
    read = read.withColumns(
        {
            "src_port": B.unsigned(either, 0, 2),
            "dst_port": B.unsigned(either, 2, 2),
            "tcp_seq": B.unsigned(tcp, 4, 4),
            "tcp_ack": B.unsigned(tcp, 8, 4),
            "tcp_flags": B.unsigned(tcp, 13, 1),
            "udp_length": B.unsigned(udp, 4, 2),
            "protocol": F.when(tcp.isNotNull(), "tcp").when(udp.isNotNull(), "udp"),
            "_body": F.coalesce(tcp_body, F.when(udp.isNotNull(), start + UDP_HEADER)),
        }
    )
    body, flags = F.col("_body"), F.col("tcp_flags")
    read = read.withColumns(
        {
            **{name: flags.bitwiseAND(bit) != 0 for name, bit in TCP_FLAG_BITS.items()},
            "payload": B.rest(data, body),
            "payload_length": F.when(
                body.isNotNull(), F.greatest(F.octet_length(data) - body, F.lit(0))
            ),
        }
    )
    return read.drop("_l4", "_tcp", "_udp", "_body")


def decode_frames(frames: DataFrame, link_type: str = "ethernet") -> DataFrame:
    """Frames with a ``data`` column to packets; ``link_type`` is ``ethernet`` or ``raw_ip``."""
    if link_type not in ("ethernet", "raw_ip"):
        raise ValueError(f"unknown link type: {link_type}")
    frames = frames.withColumn("length", F.octet_length("data"))
    if link_type == "raw_ip":
        return decode_transport(decode_ip(frames, offset=0))
    return decode_transport(decode_ip(decode_ethernet(frames)))
