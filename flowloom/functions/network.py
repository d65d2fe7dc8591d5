"""Column expressions over frames, addresses and five-tuples.

Addresses are unsigned 32-bit integers in wire order (the first octet in the low
byte) and travel as LONG. Everything here stays in the JVM but `mix64`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

TCP, UDP = 6, 17
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
ETHERNET, IPV4 = 14, 0x0800


def uint(data: Column, offset: Column | int, size: int) -> Column:
    """The big-endian unsigned integer of `size` bytes at a byte offset from 0; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    piece = data.substr(at + 1, F.lit(size))
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(piece), 16, 10).cast("long"))


def wire_address(data: Column, offset: int) -> Column:
    """Four bytes as a wire-order integer."""
    return sum((uint(data, offset + k, 1) * F.lit(1 << (8 * k)).cast("long") for k in range(1, 4)), uint(data, offset, 1))


def format_ip(address: Column) -> Column:
    """Dotted quad of a wire-order integer."""
    return F.concat_ws(".", *[F.shiftright(address, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in range(4)])


def big_endian(address: Column) -> Column:
    """The same address as a number whose order is that of dotted quads."""
    return sum((F.shiftright(address, 8 * k).bitwiseAND(F.lit(255)) * F.lit(1 << (24 - 8 * k)).cast("long") for k in range(1, 4)), address.bitwiseAND(F.lit(255)) * F.lit(1 << 24).cast("long"))


def parse_ip(text: str) -> int:
    """A rule's address, read leniently: other characters are skipped, octets aren't range-checked, sums wrap at 32 bits.

    Rules are few and come one by one; packets' addresses are decoded from their bytes.
    """
    total, shift = 0, 0
    for part in text.split("."):
        octet = 0
        for digit in filter(lambda c: "0" <= c <= "9", part):
            octet = (octet * 10 + int(digit)) & 0xFFFFFFFF
        total |= (octet << (shift % 32)) & 0xFFFFFFFF
        shift += 8
    return total


def mac(data: Column, offset: int) -> Column:
    """Six bytes as lower-case hex pairs with colons."""
    return F.regexp_replace(F.lower(F.hex(data.substr(offset + 1, 6))), "(..)(?=.)", "$1:")


def protocol_name(protocol: Column) -> Column:
    known = F.when(protocol == 1, "ICMP").when(protocol == TCP, "TCP").when(protocol == UDP, "UDP")
    return known.otherwise(F.concat(F.lit("Unknown("), protocol.cast("string"), F.lit(")")))


def tcp_flags_name(flags: Column) -> Column:
    """The set flags in the order SYN ACK FIN RST PSH URG, or `none`."""
    order = [("SYN", SYN), ("ACK", ACK), ("FIN", FIN), ("RST", RST), ("PSH", PSH), ("URG", URG)]
    names = F.concat_ws(" ", *[F.when(flags.bitwiseAND(F.lit(bit)) != 0, name) for name, bit in order])
    return F.when(names == "", "none").otherwise(names)


def keeps_direction(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """Whether a tuple is its own canonical form: its source endpoint isn't above its destination."""
    return (src_ip < dst_ip) | ((src_ip == dst_ip) & (src_port <= dst_port))


def canonical(prefix: str = "") -> list[Column]:
    """lo_ip, lo_port, hi_ip, hi_port: both directions of a conversation have the same."""
    a, p, b, q = (F.col(prefix + c) for c in ("src_ip", "src_port", "dst_ip", "dst_port"))
    keep = keeps_direction(a, p, b, q)
    return [
        F.when(keep, a).otherwise(b).alias("lo_ip"), F.when(keep, p).otherwise(q).alias("lo_port"),
        F.when(keep, b).otherwise(a).alias("hi_ip"), F.when(keep, q).otherwise(p).alias("hi_port"),
    ]


#: Fixed value: the constant that the five-tuple hash adds for each field.
HASH_CONSTANT = 0x9E3779B9


def five_tuple_hash(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """The hash that shards flows: each field is added to shifted copies of the hash so far and xored in. Stays below 2^58."""
    h = F.lit(0).cast("long")
    for field in (src_ip, dst_ip, src_port, dst_port, protocol):
        h = h.bitwiseXOR(field.cast("long") + F.lit(HASH_CONSTANT) + F.shiftleft(h, 6) + F.shiftright(h, 2))
    return h


@F.pandas_udf(DecimalType(20, 0))
def mix64(value: pd.Series) -> pd.Series:
    """A 64-bit finaliser; its unsigned products overflow LONG, so it runs in Arrow batches."""
    from decimal import Decimal

    x = value.to_numpy().astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series([Decimal(int(v)) for v in x ^ (x >> np.uint64(31))])
