import ipaddress

import pytest
from pyspark.sql import functions as F

from flowlens.functions import network as N


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


ADDRESSES = [
    "192.168.1.1", "192.168.1.2", "0.0.0.0", "255.255.255.255", "256.1.1.1", "01.2.3.4",
    "1.2.3", "", None, "not an ip", "::", "::1", "fe80::1", "2001:db8::8a2e:370:7334",
    "1:2:3:4:5:6:7:8", "::ffff:192.168.1.1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "1::2::3", "fe80::1%eth0", ":1", ":::",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8",
]


def test_ip_number_equals_the_standard_library(spark):
    def number(text):
        try:
            return float(int(ipaddress.ip_address(text)))
        except ValueError:
            return 0.0

    assert values(spark, ADDRESSES, "string", N.ip_number) == [number(a) for a in ADDRESSES]


def test_known_addresses(spark):
    got = values(spark, ["192.168.1.1", "192.168.1.2"], "string", N.ip_number)
    assert got == [3232235777.0, 3232235778.0]


def test_validators(spark):
    ips = ["192.168.1.1", "not an ip", "invalid_ip", "256.1.1.1", "01.2.3.4", "::1", None]
    assert values(spark, ips, "string", N.is_valid_ip) == [True] + [False] * 6
    ports = [80, 8080, 1, 65535, 70000, 99999, 0, -1, None]
    assert values(spark, ports, "int", N.is_valid_port) == [True] * 4 + [False] * 5
    hosts = ["example.com", "a-b.c", "-a.com", "a..b", "a" * 64, "a" * 63, "x_y", "", None]
    want = [True, True, False, False, False, True, False, False, False]
    assert values(spark, hosts, "string", N.is_valid_hostname) == want
    long = ".".join(["a" * 60] * 5)
    assert values(spark, [long], "string", N.is_valid_hostname) == [False]


def test_commands(spark):
    commands = ["ls -la", "ls -l", "rm -rf /", "rm -rf /tmp", "curl | sh", "mkfs", "echo a;b", None,
                "ls\u00a0-l\u3000x\x85y"]
    want = [False, False, True, True, True, True, True, True, False]
    assert values(spark, commands, "string", N.is_suspicious_command) == want


@pytest.mark.parametrize("text, clean", [("a;b<c>d&e|f", "abcdef"), ("plain", "plain"), ("", "")])
def test_scrub(spark, text, clean):
    assert values(spark, [text], "string", N.scrub) == [clean]


def test_flow_key_is_the_same_both_ways(spark):
    rows = [
        ("10.0.0.1", "10.0.0.2", 5, 80, "TCP"),
        ("10.0.0.2", "10.0.0.1", 80, 5, "tcp"),
        ("10.0.0.1", None, 5, 80, "tcp"),
        ("9.0.0.1", "10.0.0.1", None, 80, None),
    ]
    df = spark.createDataFrame(rows, "s string, d string, sp int, dp int, p string")
    keys = [r[0] for r in df.select(N.flow_key(*[F.col(c) for c in df.columns])).collect()]
    first = "10.0.0.1:5-10.0.0.2:80-tcp"
    assert keys == [first, first, None, "10.0.0.1:80-9.0.0.1:0-"]
