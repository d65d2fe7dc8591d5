"""Frames -> packets: header fields as JVM expressions, so filters and pruning reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import ETHERNET, IPV4, TCP, UDP, format_ip, mac, uint, wire_address

PACKET = [
    "src_mac", "dest_mac", "ether_type", "has_ip", "ip_version", "src_ip", "dst_ip", "src_ip_s", "dst_ip_s", "protocol", "ttl",
    "has_tcp", "has_udp", "src_port", "dst_port", "tcp_flags", "seq", "ack", "payload_offset", "payload_length", "frame_len",
]


def decode(raw: DataFrame) -> DataFrame:
    """Adds the columns of PACKET and `ok` to rows with `data`; fields of absent layers are null.

    A frame isn't ok if it is shorter than Ethernet's header, or claims IPv4, TCP or UDP with a header that doesn't fit.
    Frames of other types are ok, and all beyond their Ethernet header is payload.
    """
    data, n = F.col("data"), F.col("frame_len")
    base = raw.withColumn("frame_len", F.octet_length("data"))
    d = _once(
        base, ether_type=uint(data, 12, 2).cast("int"), _first=uint(data, ETHERNET, 1).cast("int"), _protocol=uint(data, 23, 1).cast("int"),
        src_mac=F.when(n >= ETHERNET, mac(data, 6)), dest_mac=F.when(n >= ETHERNET, mac(data, 0)),
    )
    first, header = F.col("_first"), F.col("_first").bitwiseAND(F.lit(15)) * 4
    is_ip = F.col("ether_type") == IPV4
    d = _once(d, has_ip=_true(is_ip & (n >= ETHERNET + 20) & (F.floor(first / 16) == 4) & (header >= 20) & (n >= header + ETHERNET)), _at=header + ETHERNET)
    ip, at = F.col("has_ip"), F.col("_at")
    tcp_header = F.when(ip & (F.col("_protocol") == TCP), (F.floor(uint(data, at + 12, 1) / 16) * 4).cast("int"))
    d = _once(
        d, ip_version=F.when(ip, F.lit(4)), protocol=F.when(ip, F.col("_protocol")), ttl=F.when(ip, uint(data, 22, 1).cast("int")), _tcp_header=tcp_header,
        src_ip=F.when(ip, wire_address(data, 26)), dst_ip=F.when(ip, wire_address(data, 30)), has_udp=_true(ip & (F.col("_protocol") == UDP) & (n >= at + 8)),
    )
    d = _once(d, has_tcp=_true((F.col("_tcp_header") >= 20) & (n >= at + 20) & (n >= at + F.col("_tcp_header"))))
    tcp, udp = F.col("has_tcp"), F.col("has_udp")
    d = _once(
        d, src_port=F.when(tcp | udp, uint(data, at, 2).cast("int")), dst_port=F.when(tcp | udp, uint(data, at + 2, 2).cast("int")),
        seq=F.when(tcp, uint(data, at + 4, 4)), ack=F.when(tcp, uint(data, at + 8, 4)), tcp_flags=F.when(tcp, uint(data, at + 13, 1).cast("int")),
        payload_offset=F.when(tcp, at + F.col("_tcp_header")).when(udp, at + 8).when(ip, at).otherwise(F.lit(ETHERNET)),
        src_ip_s=F.when(ip, format_ip(F.col("src_ip"))), dst_ip_s=F.when(ip, format_ip(F.col("dst_ip"))),
        ok=_true((n >= ETHERNET) & (ip | ~is_ip) & (~F.coalesce(F.col("protocol") == TCP, F.lit(False)) | tcp) & (~F.coalesce(F.col("protocol") == UDP, F.lit(False)) | udp)),
    )
    d = d.withColumn("payload_length", F.greatest(F.lit(0), n - F.col("payload_offset")).cast("int"))
    return d.drop("_first", "_protocol", "_at", "_tcp_header")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for a row; a plain projection would be repeated in every filter on them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def first_packets(packets: DataFrame, n: int) -> DataFrame:
    """The first n records of each capture (a run's packet limit)."""
    return packets.where(F.col("packet_no") < n)


def transport_packets(raw: DataFrame) -> DataFrame:
    """The well-formed IPv4 TCP and UDP packets."""
    return decode(raw).where("ok and has_ip and (has_tcp or has_udp)")


def payload(data: str = "data") -> Column:
    return F.col(data).substr(F.col("payload_offset") + 1, F.greatest(F.lit(0), F.octet_length(data) - F.col("payload_offset")))


def dump(packets: DataFrame) -> DataFrame:
    """One line of text for each packet, with the payload's first 32 bytes."""
    from ..functions.network import protocol_name, tcp_flags_name

    ends = F.format_string("%s:%d -> %s:%d", "src_ip_s", F.coalesce("src_port", F.lit(0)), "dst_ip_s", F.coalesce("dst_port", F.lit(0)))
    flags = F.when(F.col("has_tcp"), F.concat(F.lit(" ["), tcp_flags_name(F.col("tcp_flags")), F.lit("]"))).otherwise("")
    line = F.concat(F.format_string("#%d ", "packet_no"), ends, F.lit(" "), protocol_name(F.col("protocol")), flags, F.format_string(" len=%d", "payload_length"))
    return packets.select("capture", "packet_no", line.alias("line"), F.lower(F.hex(payload().substr(1, 32))).alias("preview"))
