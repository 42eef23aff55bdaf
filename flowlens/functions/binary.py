"""Field readers over binary headers.

A header is turned into hexadecimal text once; its fields are then substrings of that text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_hex(data: Column, offset: Column | int, size: int) -> Column:
    """Hexadecimal text of ``size`` bytes from a 0-based offset; NULL where data ends before."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    part = F.hex(F.substring(data, offset + 1, F.lit(size)))
    return F.when(F.octet_length(data) >= offset + size, part)


def field(header: Column, start: int, size: int) -> Column:
    """``size`` bytes of a header as hexadecimal text."""
    return F.substring(header, 2 * start + 1, 2 * size)


def unsigned(header: Column, start: int, size: int) -> Column:
    """Unsigned big-endian integer of up to four bytes of a header."""
    number = F.conv(field(header, start, size), 16, 10)
    return number.cast("bigint" if size > 3 else "int")


def rest(data: Column, offset: Column) -> Column:
    """All bytes from a 0-based offset on (empty where the data ends before it)."""
    return F.substring(data, offset + 1, F.octet_length(data))


def mac_text(header: Column, start: int) -> Column:
    """Six bytes as lower-case pairs joined by colons."""
    return F.lower(F.regexp_replace(field(header, start, 6), "(..)(?!$)", "$1:"))


def ipv4_text(header: Column, start: int) -> Column:
    """Four bytes in dotted form."""
    octets = [unsigned(header, start + i, 1).cast("string") for i in range(4)]
    return F.when(header.isNotNull(), F.concat_ws(".", *octets))
