"""Address, port, flow-key and text-check expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text shapes and the listed dangerous commands.
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# ``\z``: a line break at the end is part of the text (the hostname rule lets one pass).
IPV4 = rf"^({OCTET}\.){{3}}{OCTET}\z"
HOSTNAME_LABEL = r"[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
HOSTNAME = rf"^{HOSTNAME_LABEL}(\.{HOSTNAME_LABEL})*$"
# All white space counts, not only that of ASCII.
COMMAND = r"^[a-zA-Z0-9_\-\./\s\x1c-\x1f\x85\p{Z}]+$"
DANGEROUS_COMMANDS = [
    "rm -rf /",
    "dd if=/dev/zero",
    "mkfs",
    ":(){ :|:& };:",
    "> /dev/sda",
    "mv /* /dev/null",
    "wget -O- | sh",
    "curl | sh",
    "python -c \"import os; os.system('rm -rf /')\"",
]
SCRUBBED = ";<>&|"

IPV6_GROUPS = r"[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*"
IPV6 = rf"^(({IPV6_GROUPS})?::({IPV6_GROUPS})?|{IPV6_GROUPS})\z"
IPV4_TAIL = rf"^(.*:)(({OCTET}\.){{3}}{OCTET})\z"


def is_valid_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4), F.lit(False))


def is_valid_hostname(c: Column) -> Column:
    return F.coalesce(c.rlike(HOSTNAME) & (F.length(c) <= 255), F.lit(False))


def is_valid_port(c: Column) -> Column:
    return F.coalesce(c.between(1, 65535), F.lit(False))


def is_suspicious_command(c: Column) -> Column:
    """True where the text has a character outside the allowed set or a listed command."""
    listed = reduce(or_, [F.contains(c, F.lit(text)) for text in DANGEROUS_COMMANDS])
    return F.coalesce(~c.rlike(COMMAND) | listed, F.lit(True))


def scrub(c: Column) -> Column:
    return F.translate(c, SCRUBBED, "")


def ipv4_number(c: Column) -> Column:
    """The address as a number; only meaningful where the text is a valid IPv4 address."""
    parts = F.split(c, r"\.")
    a, b, d, e = (F.element_at(parts, i).cast("bigint") for i in range(1, 5))
    return ((a * 256 + b) * 256 + d) * 256 + e


def ip_number(c: Column) -> Column:
    """IPv4 or IPv6 text as DOUBLE (IPv4 exact); missing or invalid text is 0."""
    # Inside a lambda the rare case is interpreted and adds no code to the common one.
    ipv6 = F.transform(F.array(c), _ipv6_number)[0]
    return (
        F.when(c.rlike(IPV4), ipv4_number(c).cast("double"))
        .when(F.contains(c, F.lit(":")), ipv6)
        .otherwise(F.lit(0.0))
    )


def _ipv6_number(c: Column) -> Column:
    plain = F.regexp_replace(c, "%[^%]+$", "")
    tail = ipv4_number(F.regexp_extract(plain, IPV4_TAIL, 2))
    text = F.when(
        plain.rlike(IPV4_TAIL),
        F.concat(
            F.regexp_extract(plain, IPV4_TAIL, 1),
            F.hex(F.shiftright(tail, 16)),
            F.lit(":"),
            F.hex(tail.bitwiseAND(65535)),
        ),
    ).otherwise(plain)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    short = F.contains(text, F.lit("::"))
    left = groups(F.substring_index(text, "::", 1))
    right = F.when(short, groups(F.substring_index(text, "::", -1))).otherwise(
        F.array().cast("array<string>")
    )
    missing = F.lit(8) - F.size(left) - F.size(right)
    valid = text.rlike(IPV6) & F.when(short, missing >= 1).otherwise(missing == 0)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    number = F.aggregate(
        full,
        F.lit(0.0),
        lambda total, g: total * 65536.0 + F.conv(g, 16, 10).cast("double"),
    )
    return F.when(valid, number).otherwise(F.lit(0.0))


def flow_key(
    src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column
) -> Column:
    """Key shared by both directions of a conversation; NULL where an address is missing.

    Endpoints are ``ip:port`` texts compared bytewise, the smaller one first.
    """
    source = F.concat_ws(":", src_ip, F.coalesce(src_port, F.lit(0)).cast("string"))
    target = F.concat_ws(":", dst_ip, F.coalesce(dst_port, F.lit(0)).cast("string"))
    name = F.lower(F.coalesce(protocol, F.lit("")))
    key = F.concat_ws("-", F.least(source, target), F.greatest(source, target), name)
    return F.when(src_ip.isNotNull() & dst_ip.isNotNull(), key)
