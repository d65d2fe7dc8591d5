"""Aggregates over packets and flows. All have partial sums before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import five_tuple_hash, mix64


def inspection_counters(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per capture: packets that named their flow, names taken from TLS, and those that told an application beyond the protocol's own.

    judged and verdicts: the rows of flows.judged_packets and flows.verdicts, one for each packet.
    """
    key = ["capture", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol", "packet_no"]
    named = judged.select(*key, "cand_kind", "cand_app").join(verdicts.where("named").select(*key), key)
    tls, http = F.col("cand_kind") == "tls", F.col("cand_kind") == "http"
    hit = (tls & ~F.col("cand_app").isin("Unknown", "HTTPS")) | (http & ~F.col("cand_app").isin("Unknown", "HTTP"))
    return named.groupBy("capture").agg(F.count("*").alias("classified"), F.count_if(tls).alias("sni_extractions"), F.count_if(hit).alias("classification_hits"))


def capture_totals(packets: DataFrame) -> DataFrame:
    """Packets and bytes, TCP and UDP, of each capture; with a column `reason` also forwarded and dropped."""
    more = [F.count_if(F.col("reason").isNull()).alias("forwarded_packets"), F.count_if(F.col("reason").isNotNull()).alias("dropped_packets")] if "reason" in packets.columns else []
    return packets.groupBy("capture").agg(
        F.count("*").alias("total_packets"), F.sum("frame_len").alias("total_bytes"), F.count_if(F.col("protocol") == 6).alias("tcp_packets"), F.count_if(F.col("protocol") == 17).alias("udp_packets"), *more
    )


def distribution(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """How many rows each value has, with its share in percent."""
    by = by or []
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
    both = counts.join(rows.groupBy(*by).agg(F.count("*").alias("total")), by) if by else counts.withColumn("total", F.lit(rows.count()))
    return both.select(*by, column, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def top_names(flows: DataFrame, limit: int = 20) -> DataFrame:
    """The names that most flows of a capture have; ties go to the name seen first, then to the lesser one."""
    counts = flows.where("sni <> ''").groupBy("capture", "sni").agg(F.count("*").alias("n"), F.min("first_packet_no").alias("first_seen"))
    order = Window.partitionBy("capture").orderBy(F.desc("n"), "first_seen", "sni")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def classification(flows: DataFrame) -> DataFrame:
    """Named and unknown flows of each capture, in percent, with the report's bar of one mark for 5 percent."""
    f = flows.groupBy("capture").agg(F.count("*").alias("flows"), F.count_if(F.col("app") != "Unknown").alias("classified"))
    share = F.when(F.col("flows") > 0, 100.0 * F.col("classified") / F.col("flows")).otherwise(0.0)
    return f.withColumns({"percent": share, "bar": F.repeat(F.lit("#"), F.floor(share / 5).cast("int"))})


def drop_rate(totals: DataFrame) -> DataFrame:
    return totals.withColumn("drop_rate", F.when(F.col("total_packets") > 0, 100.0 * F.col("dropped_packets") / F.col("total_packets")).otherwise(0.0))


def shard_loads(packets: DataFrame, balancers: int, paths: int, decorrelate: bool = True) -> DataFrame:
    """Packets that each balancer and path of the two-level sharding would get: by the tuple's hash, then by its mixed hash."""
    h = five_tuple_hash(*(F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")))
    p = packets.withColumn("_h", h)
    inner = mix64(F.col("_h")) if decorrelate else F.col("_h")
    return p.groupBy((F.col("_h") % balancers).cast("int").alias("balancer"), (inner % paths).cast("int").alias("path")).agg(F.count("*").alias("packets"))


def last_app_of_name(packets: DataFrame) -> DataFrame:
    """Each name with the application that its last packet was counted for."""
    return packets.where("sni <> ''").groupBy("capture", "sni").agg(F.max_by("app", "packet_no").alias("app"))
