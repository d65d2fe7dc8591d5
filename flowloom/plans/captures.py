"""Captures made by Spark from the driver's tables: every event becomes a frame.

A user is a client 10.0.x.y, its key a server 93.184.x.y; the key also picks the service. Event types are TCP flags, every third
event is the server's. Clicks carry a request for the host of a page (page numbers follow the events', so all pages are asked for):
TLS, HTTP or DNS by the service's port. Every second page names a well-known service instead of its own host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The service of a key, and the TCP flags of an event type.
SERVICES = [443, 80, 53, 8080, 9001]
FLAGS = {"signup": 2, "view": 18, "click": 24, "purchase": 17, "error": 4}
#: Captures at least, and events for which there is one more.
CAPTURES, CAPTURE_EVENTS = 4, 20_000
# Hosts of well-known services with their applications, and some that only look like one.
KNOWN_HOSTS = [
    ("www.youtube.com", "YouTube"), ("i.ytimg.com", "YouTube"), ("youtu.be", "YouTube"), ("yt3.ggpht.com", "YouTube"), ("www.instagram.com", "Instagram"), ("scontent.cdninstagram.com", "Instagram"),
    ("web.whatsapp.com", "WhatsApp"), ("wa.me", "WhatsApp"), ("scontent.fbcdn.net", "Facebook"), ("m.facebook.com", "Facebook"), ("fb.com", "Facebook"), ("about.meta.com", "Facebook"), ("static.fbsbx.com", "Facebook"),
    ("www.netflix.com", "Netflix"), ("ipv4.nflxvideo.net", "Netflix"), ("assets.nflximg.net", "Netflix"), ("raw.githubusercontent.com", "GitHub"), ("api.github.com", "GitHub"),
    ("www.tiktok.com", "TikTok"), ("v16.tiktokcdn.com", "TikTok"), ("musical.ly", "TikTok"), ("log.bytedance.com", "TikTok"), ("web.telegram.org", "Telegram"), ("t.me", "Telegram"),
    ("open.spotify.com", "Spotify"), ("i.scdn.co", "Spotify"), ("gateway.discord.gg", "Discord"), ("cdn.discordapp.com", "Discord"), ("us02web.zoom.us", "Zoom"), ("api.twitter.com", "Twitter/X"), ("pbs.twimg.com", "Twitter/X"),
    ("x.com", "Twitter/X"), ("t.co", "Twitter/X"), ("WWW.GOOGLE.COM", "Google"), ("fonts.gstatic.com", "Google"), ("maps.googleapis.com", "Google"), ("lh3.ggpht.com", "Google"), ("redirector.gvt1.com", "Google"),
    ("s3.amazonaws.com", "Amazon"), ("d111.cloudfront.net", "Amazon"), ("docs.aws.dev", "Amazon"), ("www.microsoft.com", "Microsoft"), ("msn.com", "Microsoft"), ("outlook.office365.com", "Microsoft"), ("login.live.com", "Microsoft"),
    ("portal.azure.com", "Microsoft"), ("www.bing.com", "Microsoft"), ("www.apple.com", "Apple"), ("gateway.icloud.com", "Apple"), ("is1.mzstatic.com", "Apple"), ("itunes.example.org", "Apple"),
    ("cdnjs.cloudflare.com", "Cloudflare"), ("cf-ray.example.org", "Cloudflare"), ("abbot.com", "HTTPS"), ("tubing.net", "HTTPS"), ("pineapple.com", "HTTPS"), ("zoomed.org", "HTTPS"), ("netflx.com", "HTTPS"),
]


def _be(value: Column, size: int) -> Column:
    """A number as `size` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _ip(value: Column) -> Column:
    """A wire-order address as four bytes."""
    return F.concat(*[_be(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255)), 1) for k in range(4)])


def _bytes(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("binary")


def page_hosts(pages: DataFrame) -> DataFrame:
    """page_id, host: the page's own, or that of a well-known service."""
    known = F.element_at(F.array(*[F.lit(h) for h, _ in KNOWN_HOSTS]), (F.floor(F.col("page_id") / 2) % len(KNOWN_HOSTS)).cast("int") + 1)
    return pages.select("page_id", F.when(F.col("page_id") % 2 == 1, known).otherwise(F.expr("parse_url(url, 'HOST')")).alias("host"))


def tuples(events: DataFrame, pages: DataFrame) -> DataFrame:
    """What the frames are made of: capture, packet_no, addresses, ports, flags and the host asked for (or null)."""
    k = F.get_json_object("props", "$.k").cast("long")
    hosts = page_hosts(pages).withColumnRenamed("page_id", "_page")
    captures = max(CAPTURES, events.count() // CAPTURE_EVENTS)
    e = events.withColumns({"k": F.coalesce(k, F.lit(0).cast("long")), "_page": F.col("event_id") % max(1, pages.count())})
    e = e.join(hosts, "_page", "left")
    client = F.lit(10).cast("long") + F.lit(65536) * (F.floor(F.col("user_id") / 256) % 256) + F.lit(16777216) * (F.col("user_id") % 256)
    server = F.lit(93 + 184 * 256).cast("long") + F.lit(65536) * (F.floor(F.col("k") / 256) % 256) + F.lit(16777216) * (F.col("k") % 256)
    service = F.element_at(F.array(*map(F.lit, SERVICES)), (F.col("k") % len(SERVICES)).cast("int") + 1)
    port = (F.lit(40000) + F.col("user_id") % 20000).cast("int")
    back = F.col("event_id") % 3 == 0
    return e.select(
        F.concat(F.lit("events-"), (F.col("event_id") % captures).cast("string"), F.lit(".pcap")).alias("capture"), F.floor(F.col("event_id") / captures).cast("long").alias("packet_no"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_sec"), (F.col("event_id") % 1_000_000).alias("ts_frac"),
        F.when(back, server).otherwise(client).alias("src_ip"), F.when(back, client).otherwise(server).alias("dst_ip"),
        F.when(back, service).otherwise(port).alias("src_port"), F.when(back, port).otherwise(service).alias("dst_port"),
        F.when(service == 53, 17).otherwise(6).alias("protocol"), F.create_map(*[F.lit(x) for kv in FLAGS.items() for x in kv])[F.col("event_type")].alias("tcp_flags"),
        F.when((F.col("event_type") == "click") & ~back, F.col("host")).alias("host"), F.floor(F.abs("value")).cast("int").alias("pad"),
    )


def frames(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw rows (capture, packet_no, ts_sec, ts_frac, nanos, incl_len, orig_len, data)."""
    t = tuples(events, pages)
    host = F.col("host")
    name = _bytes(host)
    n = F.octet_length(name)
    server_name = F.concat(_be(F.lit(0), 2), _be(n + 5, 2), _be(n + 3, 2), _be(F.lit(0), 1), _be(n, 2), name)
    body = F.concat(F.unhex(F.lit("0303" + "11" * 32 + "00" + "00021301" + "0100")), _be(n + 9, 2), server_name)
    handshake = F.concat(F.unhex(F.lit("01")), _be(F.octet_length(body), 3), body)
    hello = F.concat(F.unhex(F.lit("160301")), _be(F.octet_length(handshake), 2), handshake)
    request = _bytes(F.concat(F.lit("GET / HTTP/1.1\r\nAccept: */*\r\nHost: "), host, F.lit("\r\n\r\n")))
    labels = F.aggregate(F.split(host, "\\."), F.unhex(F.lit("")), lambda a, x: F.concat(a, _be(F.length(x), 1), x.cast("binary")))
    question = F.concat(F.unhex(F.lit("123401000001000000000000")), labels, F.unhex(F.lit("0000010001")))
    load = F.when(host.isNull(), F.unhex(F.lit(""))).when(F.col("dst_port") == 443, hello).when(F.col("dst_port") == 53, question).otherwise(request)
    load = F.when(F.col("host").isNull(), F.unhex(F.repeat(F.lit("00"), F.col("pad") % 40))).otherwise(load)
    size = F.octet_length("load")
    udp = F.concat(_be(size + 8, 2), F.unhex(F.lit("0000")))
    tcp = F.concat(_be(F.col("packet_no"), 4), F.unhex(F.lit("0000000050")), _be(F.col("tcp_flags"), 1), F.unhex(F.lit("ffff00000000")))
    transport = F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2), F.when(F.col("protocol") == 17, udp).otherwise(tcp))
    total = size + F.when(F.col("protocol") == 17, 28).otherwise(40)
    header = F.concat(F.unhex(F.lit("4500")), _be(total, 2), F.unhex(F.lit("00000000")), _be(F.lit(64), 1), _be(F.col("protocol"), 1), F.unhex(F.lit("0000")), _ip(F.col("src_ip")), _ip(F.col("dst_ip")))
    data = F.concat(F.unhex(F.lit("020000000001" + "020000000002" + "0800")), header, transport, F.col("load"))
    f = t.withColumn("load", load).withColumn("data", data)
    length = F.octet_length("data").cast("long")
    return f.select("capture", "packet_no", "ts_sec", "ts_frac", F.lit(False).alias("nanos"), length.alias("incl_len"), length.alias("orig_len"), "data")
