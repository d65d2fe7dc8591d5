"""Flow reports: the flows worth showing, numbered, with names cleaned and addresses redacted."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import big_endian, format_ip
from ..functions.text import sanitize_hostname
from . import aggregates

MAX_FLOWS = 40

# The address blocks that aren't public (private use, loopback, link-local, documentation, multicast, reserved), and the two public exceptions.
INTERNAL = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
PUBLIC = "192.0.0.9/32 192.0.0.10/32".split()


def is_internal(address: Column) -> Column:
    """Whether a wire-order address isn't a public one."""
    n = big_endian(address)

    def within(blocks: list[str]) -> Column:
        nets = [ipaddress.ip_network(b) for b in blocks]
        test = F.lit(False)
        for net in nets:
            test = test | n.between(int(net.network_address), int(net.broadcast_address))
        return test

    return within(INTERNAL) & ~within(PUBLIC)


def pseudonym(number: Column) -> Column:
    """host_a to host_z, host_aa and so on for 0, 1, ... (up to three letters by expression, which is 18,278 hosts; the cap on flows keeps far below)."""
    letter = lambda n: F.char(F.lit(97) + n.cast("int") % 26)
    two, three = F.floor(number / 26) - 1, F.floor((number - 26) / 676) - 1
    return F.concat(F.lit("host_"), F.when(number >= 702, letter(three)).otherwise(""), F.when(number >= 26, letter(two)).otherwise(""), letter(number))


def select_flows(flows: DataFrame, limit: int = MAX_FLOWS) -> DataFrame:
    """The `limit` most telling flows of each capture with flow_id: blocked first, then named, then by bytes; ties by first packet.

    They are numbered from 0 by destination port, source port and wire-order source address.
    """
    volume = F.col("bytes_out") + F.col("bytes_in")
    worth = Window.partitionBy("capture").orderBy((F.col("state") == "BLOCKED").desc(), (F.coalesce(F.col("sni"), F.lit("")) != "").desc(), volume.desc(), "first_packet_no")
    kept = flows.withColumn("_rank", F.row_number().over(worth)).where(F.col("_rank") <= limit)
    number = Window.partitionBy("capture").orderBy("dst_port", "src_port", "src_ip", "_rank")
    return kept.withColumn("flow_id", F.row_number().over(number) - 1).drop("_rank")


def redact(flows: DataFrame, mode: str = "redact_private") -> DataFrame:
    """Adds src_ip_s and dst_ip_s: as they are (full), none, or pseudonyms for internal addresses in the order of their first use."""
    if mode == "none":
        return flows.withColumns({"src_ip_s": F.lit(None).cast("string"), "dst_ip_s": F.lit(None).cast("string")})
    shown = flows.withColumns({"src_ip_s": format_ip(F.col("src_ip")), "dst_ip_s": format_ip(F.col("dst_ip"))})
    if mode == "full":
        return shown
    used = flows.select("capture", F.inline(F.array(F.struct((F.col("flow_id") * 2).alias("at"), F.col("src_ip").alias("ip")), F.struct((F.col("flow_id") * 2 + 1).alias("at"), F.col("dst_ip").alias("ip")))))
    first = used.where(is_internal(F.col("ip"))).groupBy("capture", "ip").agg(F.min("at").alias("at"))
    names = first.select("capture", "ip", pseudonym(F.row_number().over(Window.partitionBy("capture").orderBy("at")) - 1).alias("label"))
    for side in ("src_ip", "dst_ip"):
        label = names.select("capture", F.col("ip").alias(side), F.col("label").alias(f"_{side}"))
        shown = shown.join(label, ["capture", side], "left").withColumn(f"{side}_s", F.coalesce(f"_{side}", f"{side}_s")).drop(f"_{side}")
    return shown


def flow_records(flows: DataFrame, mode: str = "redact_private", limit: int = MAX_FLOWS) -> DataFrame:
    """The rows of a report."""
    protocol = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").otherwise("OTHER")
    r = redact(select_flows(flows, limit), mode)
    return r.select(
        F.element_at(F.split("capture", "/"), -1).alias("capture"), "flow_id", protocol.alias("protocol"), "dst_port", "src_port",
        sanitize_hostname(F.when(F.col("sni") != "", F.col("sni"))).alias("server_name"), F.col("app").alias("application"), "state", F.col("action").alias("verdict"),
        "packets_out", "packets_in", "bytes_out", "bytes_in", "syn_seen", "syn_ack_seen", "fin_seen", F.col("src_ip_s").alias("src_ip"), F.col("dst_ip_s").alias("dst_ip"),
    )


def notes(flows: DataFrame, records: DataFrame, mode: str, limit: int = MAX_FLOWS) -> DataFrame:
    """What a reader should know of each capture's report."""
    total = flows.groupBy("capture").agg(F.count("*").alias("n"))
    hosts = records.select("capture", F.explode(F.array("src_ip", "dst_ip")).alias("h")).where("h like 'host_%'").groupBy("capture").agg(F.countDistinct("h").alias("h"))
    cut = F.when(F.col("n") > limit, F.format_string("%d flows are in the capture, the %d most telling are shown", "n", F.lit(limit)))
    masked = F.when(F.lit(mode == "none"), "addresses are withheld").when(F.col("h") > 0, F.format_string("%d internal addresses have pseudonyms", "h"))
    return total.join(hosts, "capture", "left").select("capture", F.filter(F.array(cut, masked), lambda x: x.isNotNull()).alias("notes"))


def _fixed(part: Column, whole: Column, places: int) -> Column:
    """A share in percent with a fixed number of places, rounded half up in whole numbers, so that no sum's or quotient's last bit shows."""
    unit = 10**places
    scaled = F.when(whole > 0, F.floor((2 * 100 * unit * part + whole) / (2 * whole))).otherwise(F.lit(0)).cast("long")
    return F.concat(F.floor(scaled / unit).cast("string"), F.lit("."), F.lpad((scaled % unit).cast("string"), places, "0"))


def capture_texts(totals: DataFrame, flows: DataFrame) -> DataFrame:
    """(capture, text) of every capture: its totals, its applications with a bar of one mark for 5 percent, and its top names. Rendered in tasks.

    totals: as aggregates.capture_totals with reasons; flows: (capture, app, sni, first_packet_no). A capture's lines are few: one, one for each
    application, and twenty names at most.
    """
    line = lambda section, at, tie, text: [F.lit(section).alias("section"), at.cast("long").alias("at"), tie.alias("tie"), text.alias("line")]
    head = F.concat(
        F.format_string("%s: %d packets, %d bytes, %d TCP, %d UDP, %d forwarded, %d dropped (", "capture", "total_packets", "total_bytes", "tcp_packets", "udp_packets", "forwarded_packets", "dropped_packets"),
        _fixed(F.col("dropped_packets"), F.col("total_packets"), 2), F.lit("%)"),
    )
    heads = totals.select("capture", *line(0, F.lit(0), F.lit(""), head))
    counts = flows.groupBy("capture", "app").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("capture")))
    bar = F.repeat(F.lit("#"), F.floor(20 * F.col("n") / F.col("total")).cast("int"))
    apps = counts.select("capture", *line(1, -F.col("n"), F.col("app"), F.concat(F.format_string("  %-16s%8d  %5s%%  ", F.col("app"), F.col("n"), _fixed(F.col("n"), F.col("total"), 1)), bar)))
    short = F.when(F.length("sni") > 35, F.concat(F.substring("sni", 1, 32), F.lit("..."))).otherwise(F.col("sni"))
    names = aggregates.top_names(flows).select("capture", *line(2, F.col("rank"), F.lit(""), F.format_string("  %-36s%6d", short, F.col("n"))))
    lines = heads.union(apps).union(names).groupBy("capture").agg(F.sort_array(F.collect_list(F.struct("section", "at", "tie", "line"))).alias("lines"))
    return lines.select("capture", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
