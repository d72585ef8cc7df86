"""Variable-byte integers and the sizes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value: int) -> bytes:
    """Seven bits a byte, the lowest first; the top bit marks the last byte."""
    if value < 0:
        raise ValueError("only unsigned integers can be encoded")
    out = bytearray()
    while value > 127:
        out.append(value & 127)
        value >>= 7
    out.append(value | 128)
    return bytes(out)


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """The integer that starts at a byte, and the byte after it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte & 128:
            return value, at
        shift += 7


def encoded_size(value: Column) -> Column:
    """Bytes that encode() takes: one for each seven bits, at least one."""
    size = F.lit(1).cast("bigint")
    for bits in range(7, 63, 7):
        size = size + (value >= F.lit(1 << bits)).cast("bigint")
    return size


def shrink_percent(encoded: Column, naive: Column) -> Column:
    return F.when(naive > 0, F.lit(100.0) * (F.lit(1.0) - encoded / naive)).otherwise(F.lit(0.0))
