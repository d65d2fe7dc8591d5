"""Signals: thirteen threshold tests over each capture's flow records, in one aggregation.

Every signal is a row (capture, signal, severity, confidence, evidence, flow_ids). A capture's report has at most
a few dozen flows, so its lists are small; the tests themselves are conditional aggregates with partial sums.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entropy, leftmost_label, parent_domain

# Destination ports that are common.
COMMON_PORTS = [20, 21, 22, 25, 53, 67, 68, 80, 110, 123, 143, 161, 389, 443, 445, 465, 587, 636, 853, 993, 995, 1900, 3478, 5353, 8080, 8443]
SEVERITY = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3}


@dataclass(frozen=True)
class Thresholds:
    unknown_share: float = 0.20
    unknown_flows: int = 3
    dns_share: float = 0.15
    dns_flows: int = 5
    dns_distinct: float = 0.90
    dns_named: int = 5
    label_length: int = 30
    label_entropy: float = 3.5
    scan_ports: int = 8
    half_open_flows: int = 3
    half_open_share: float = 0.50
    upload_ratio: float = 3.0
    upload_bytes: int = 4096
    odd_port_flows: int = 2
    odd_port_bytes: int = 512
    presence: int = 1


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.bround(n / d, 6)).otherwise(F.lit(0.0))


def confidence(value: Column, threshold: float, ceiling: float) -> Column:
    """0.5 at the threshold, growing to 0.95."""
    return F.bround(F.least(F.lit(0.95), F.greatest(F.lit(0.5), F.lit(0.5) + F.lit(0.45) * (value - F.lit(threshold)) / F.lit(ceiling - threshold))), 4)


def _ids(test: Column) -> Column:
    return F.sort_array(F.collect_set(F.when(test, F.col("flow_id"))))


def _fan_out(records: DataFrame, t: Thresholds) -> DataFrame:
    """The source with the most destination ports of each capture; the lesser name wins ties."""
    source = F.coalesce("src_ip", F.lit("<withheld>"))
    by = records.groupBy("capture", source.alias("source")).agg(F.countDistinct("dst_port").alias("ports"), F.count("*").alias("flows"), F.sort_array(F.collect_set("flow_id")).alias("ids"))
    best = by.groupBy("capture").agg(F.max_by(F.struct("ports", "flows", "ids"), F.struct("ports", F.lit(None).cast("string"))).alias("x"), F.max("ports").alias("most"))
    tied = by.join(best.select("capture", "most"), "capture").where("ports = most")
    return tied.groupBy("capture").agg(F.min_by(F.struct("ports", "flows", "ids"), "source").alias("fan")).where(F.col("fan.ports") >= t.scan_ports)


def _parents(records: DataFrame) -> DataFrame:
    """The most frequent parent domain of named DNS flows; the one with the least flow_id wins ties."""
    dns = records.where("protocol = 'UDP' and dst_port = 53 and server_name is not null")
    by = dns.groupBy("capture", parent_domain(F.col("server_name")).alias("parent")).agg(F.count("*").alias("n"), F.min("flow_id").alias("first"))
    return by.groupBy("capture").agg(F.max_by(F.struct("parent", "n"), F.struct("n", -F.col("first"))).alias("top"))


def measures(records: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per capture with all that the tests need."""
    tcp, udp, port, name = F.col("protocol") == "TCP", F.col("protocol") == "UDP", F.col("dst_port"), F.col("server_name")
    named = name.isNotNull() & (name != "")
    dns = udp & (port == 53)
    label = leftmost_label(name)
    odd_label = dns & named & ((F.length(label) >= t.label_length) | (entropy(label) >= t.label_entropy))
    upload = (F.col("bytes_out") >= t.upload_bytes) & (F.col("bytes_out") >= t.upload_ratio * F.greatest(F.col("bytes_in"), F.lit(1)))
    odd_port = ~port.isin(*COMMON_PORTS) & (F.col("bytes_out") + F.col("bytes_in") >= t.odd_port_bytes)
    blocked = (F.col("verdict") == "DROP") | (F.col("state") == "BLOCKED")
    unknown, syn = F.col("application") == "Unknown", tcp & F.col("syn_seen")
    bare_tls = tcp & (port == 443) & ~named
    tests = {
        "unknown": unknown, "dns": dns, "dns_named": dns & named, "odd_label": odd_label, "half_open": syn & ~F.col("syn_ack_seen"), "bare_tls": bare_tls,
        "http": tcp & (port == 80), "quic": udp & (port == 443), "upload": upload, "odd_port": odd_port, "blocked": blocked,
    }
    counts = {
        "syn": syn, "tls": tcp & (port == 443), "web": port.isin(80, 443), "named": named, "download": F.col("bytes_in") > F.col("bytes_out"), "tcp": tcp, "completed": tcp & F.col("syn_ack_seen"),
    }
    m = records.groupBy("capture").agg(
        F.count("*").alias("flows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in {**tests, **counts}.items()],
        *[_ids(c).alias(f"ids_{k}") for k, c in tests.items()],
        F.countDistinct(F.when(dns & named, name)).alias("dns_distinct"), F.max(F.when(odd_label, F.length(label))).alias("longest_label"), F.max(F.when(odd_label, entropy(label))).alias("highest_entropy"),
        F.sum(F.when(upload, F.col("bytes_out"))).alias("up_out"), F.sum(F.when(upload, F.col("bytes_in"))).alias("up_in"),
        F.slice(F.sort_array(F.collect_set(F.when(odd_port, port))), 1, 64).alias("odd_ports"), F.countDistinct(F.when(tcp & (port == 80) & named, name)).alias("http_names"),
    )
    return m.join(_fan_out(records, t), "capture", "left").join(_parents(records), "capture", "left")


def signals(records: DataFrame, totals: DataFrame | None = None, t: Thresholds = Thresholds(), rules: int = 0) -> DataFrame:
    """The signals that fire, in order: severity and confidence descending, then name.

    totals: (capture, dropped_packets, unknown_flows) of whole captures; without it these are taken from the records.
    """
    m = measures(records, t)
    if totals is not None:
        m = m.join(totals, "capture", "left").fillna(0, ["dropped_packets", "unknown_flows"])
    else:
        m = m.withColumns({"dropped_packets": F.lit(0).cast("long"), "unknown_flows": F.col("n_unknown")})
    c, flows = F.col, F.col("flows")
    unknown, dns = ratio(c("n_unknown"), flows), ratio(c("n_dns"), flows)
    distinct, half = ratio(c("dns_distinct"), c("n_dns_named")), ratio(c("n_half_open"), c("n_syn"))
    bare, up = ratio(c("n_bare_tls"), c("n_tls")), F.bround(c("up_out") / F.greatest(c("up_in"), F.lit(1)), 4)
    shares = [ratio(c("n_web"), flows), ratio(c("n_named"), flows), ratio(c("n_download"), flows), ratio(c("n_completed"), c("n_tcp"))]
    fit = F.bround((shares[0] + shares[1] + shares[2] + shares[3]) / 4, 4)
    none = F.array().cast("array<int>")
    rows = [
        ("unknown_app_share", (c("n_unknown") >= t.unknown_flows) & (unknown >= t.unknown_share), F.when(unknown >= 0.5, "MEDIUM").otherwise("LOW"), confidence(unknown, t.unknown_share, 0.8),
         {"unknown_flow_count": c("n_unknown"), "total_flow_count": flows, "ratio": unknown, "distribution_unknown_count": c("unknown_flows")}, c("ids_unknown")),
        ("dns_high_volume", (c("n_dns") >= t.dns_flows) & (dns >= t.dns_share), F.lit("LOW"), confidence(dns, t.dns_share, 0.6), {"dns_flow_count": c("n_dns"), "total_flow_count": flows, "ratio": dns}, c("ids_dns")),
        ("dns_high_cardinality", (c("n_dns_named") >= t.dns_named) & (distinct >= t.dns_distinct), F.lit("MEDIUM"), confidence(distinct, t.dns_distinct, 1.0),
         {"dns_flow_count": c("n_dns_named"), "distinct_name_count": c("dns_distinct"), "ratio": distinct, "top_parent_domain": c("top.parent"), "top_parent_name_count": c("top.n")}, c("ids_dns_named")),
        ("dns_anomalous_label", c("n_odd_label") > 0, F.lit("MEDIUM"), confidence(c("highest_entropy"), t.label_entropy, 4.5),
         {"flagged_flow_count": c("n_odd_label"), "longest_label_length": c("longest_label"), "highest_label_entropy": F.bround("highest_entropy", 4), "length_threshold": F.lit(t.label_length), "entropy_threshold": F.lit(t.label_entropy)}, c("ids_odd_label")),
        ("scan_port_fanout", c("fan").isNotNull(), F.lit("MEDIUM"), confidence(c("fan.ports"), t.scan_ports, t.scan_ports * 4), {"distinct_destination_ports": c("fan.ports"), "flow_count": c("fan.flows")}, c("fan.ids")),
        ("scan_half_open", (c("n_half_open") >= t.half_open_flows) & (half >= t.half_open_share), F.lit("MEDIUM"), confidence(half, t.half_open_share, 1.0), {"half_open_count": c("n_half_open"), "tcp_flow_count": c("n_syn"), "ratio": half}, c("ids_half_open")),
        ("tls_without_sni", c("n_bare_tls") >= t.presence, F.lit("LOW"), confidence(bare, 0.0, 1.0), {"tls_without_sni_count": c("n_bare_tls"), "tls_flow_count": c("n_tls"), "ratio": bare}, c("ids_bare_tls")),
        ("plaintext_http", c("n_http") >= t.presence, F.lit("LOW"), F.lit(0.9), {"http_flow_count": c("n_http"), "total_flow_count": flows, "distinct_hostnames": c("http_names")}, c("ids_http")),
        ("quic_present", c("n_quic") >= t.presence, F.lit("INFO"), F.lit(0.9), {"quic_flow_count": c("n_quic"), "total_flow_count": flows}, c("ids_quic")),
        ("upload_asymmetry", c("n_upload") > 0, F.lit("MEDIUM"), confidence(up, t.upload_ratio, t.upload_ratio * 10),
         {"flagged_flow_count": c("n_upload"), "bytes_out": c("up_out"), "bytes_in": c("up_in"), "out_in_ratio": up, "ratio_threshold": F.lit(t.upload_ratio)}, c("ids_upload")),
        ("nonstandard_port_egress", c("n_odd_port") >= t.odd_port_flows, F.lit("LOW"), confidence(c("n_odd_port"), t.odd_port_flows, max(t.odd_port_flows * 5, 10)),
         {"flagged_flow_count": c("n_odd_port"), "distinct_ports": F.to_json("odd_ports"), "min_bytes_threshold": F.lit(t.odd_port_bytes)}, c("ids_odd_port")),
        ("blocked_traffic_present", (c("n_blocked") > 0) | (c("dropped_packets") > 0), F.lit("LOW"), F.lit(0.95), {"blocked_flow_count": c("n_blocked"), "dropped_packets": c("dropped_packets"), "configured_rule_count": F.lit(rules)}, c("ids_blocked")),
        ("baseline_web_browsing", flows > 0, F.lit("INFO"), F.bround(F.least(F.lit(0.95), F.greatest(F.lit(0.1), fit)), 4),
         {"web_port_share": shares[0], "named_flow_share": shares[1], "download_dominant_share": shares[2], "completed_handshake_share": shares[3], "browsing_fit": fit, "total_flow_count": flows}, none),
    ]
    made = [
        F.when(fires, F.struct(F.lit(name).alias("signal"), severity.alias("severity"), conf.cast("double").alias("confidence"), F.create_map(*[x for k, v in sorted(evidence.items()) for x in (F.lit(k), v.cast("string"))]).alias("evidence"), ids.cast("array<int>").alias("flow_ids")))
        for name, fires, severity, conf, evidence, ids in rows
    ]
    fired = m.select("capture", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("s")).select("capture", "s.*")
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")]
    order = Window.partitionBy("capture").orderBy(rank.desc(), F.col("confidence").desc(), "signal")
    return fired.withColumn("position", F.row_number().over(order))


def _signal_ids(signal: pd.Series, evidence: pd.Series) -> pd.Series:
    def one(name: str, held: dict) -> str:
        text = json.dumps({k: _number(v) for k, v in sorted(dict(held).items())}, sort_keys=True, ensure_ascii=False)
        return f"{name}#{hashlib.sha256(f'{name}\n{text}'.encode()).hexdigest()[:12]}"

    return pd.Series([one(n, e) for n, e in zip(signal, evidence)])


def _number(text: str):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


def with_signal_ids(fired: DataFrame) -> DataFrame:
    """Adds signal_id: the name and the start of a hash over its evidence as JSON (at most 13 rows a capture)."""
    from pyspark.sql.types import StringType

    return fired.withColumn("signal_id", F.pandas_udf(_signal_ids, StringType())("signal", "evidence"))


def profile(records: DataFrame) -> DataFrame:
    """(capture, kind, value, n, position): distributions of protocol, verdict, state and the ten first ports."""
    each = records.select("capture", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"), (F.col(c).cast("long") if k == "port" else F.lit(0).cast("long")).alias("number")) for k, c in (("protocol", "protocol"), ("verdict", "verdict"), ("state", "state"), ("port", "dst_port"))])))
    counts = each.groupBy("capture", "kind", "value", "number").agg(F.count("*").alias("n"))
    order = Window.partitionBy("capture", "kind").orderBy(F.desc("n"), "number", "value")
    return counts.withColumn("position", F.row_number().over(order)).where("kind <> 'port' or position <= 10").drop("number")
