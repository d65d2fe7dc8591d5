"""Capture files, decoding, names in payloads, flows and rules against plain versions."""

import random
import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.functions import apps, network, payload
from flowloom.operators import aggregates, decode, flows, inspect
from flowloom.sources import pcap, rules


def hello(name: bytes, extra: bytes = b"", kind: int = 0) -> bytes:
    sni = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, kind, len(name)) + name
    body = b"\x03\x03" + b"r" * 32 + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack(">H", len(extra + sni)) + extra + sni
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


def question(name: str, flags: int = 0x0100, count: int = 1) -> bytes:
    return struct.pack(">HHHHHH", 7, flags, count, 0, 0, 0) + b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\x00\x00\x01\x00\x01"


def frame(src: str, dst: str, sport: int, dport: int, proto: int = 6, flags: int = 24, load: bytes = b"") -> bytes:
    l4 = struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 0x50, flags, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8 + len(load), 0)
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(l4) + len(load), 0, 0, 64, proto, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return b"\x02" * 6 + b"\x04" * 6 + b"\x08\x00" + ip + l4 + load


def raw(spark, frames, capture="c.pcap"):
    return spark.createDataFrame([(capture, k, 1_700_000_000 + k, 5, False, len(f), len(f), bytearray(f)) for k, f in enumerate(frames)], pcap.RAW)


def capture_bytes(frames, order="<", magic=0xA1B2C3D4, snap=65535):
    return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, 1) + b"".join(struct.pack(order + "IIII", 1, 2, len(f), len(f)) + f for f in frames)


@pytest.mark.parametrize("order,magic,nanos", [("<", 0xA1B2C3D4, False), (">", 0xA1B2C3D4, False), ("<", 0xA1B23C4D, True), (">", 0xA1B23C4D, True)])
def test_capture_formats(spark, tmp_path, order, magic, nanos):
    (tmp_path / "x.pcap").write_bytes(capture_bytes([b"abc", b"defg"], order, magic))
    got = pcap.read_captures(spark, str(tmp_path)).orderBy("packet_no").collect()
    assert [(r.capture, r.packet_no, r.ts_sec, r.ts_frac, r.nanos, bytes(r.data)) for r in got] == [("x.pcap", 0, 1, 2, nanos, b"abc"), ("x.pcap", 1, 1, 2, nanos, b"defg")]


def test_a_bad_record_ends_the_scan(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture_bytes([b"abc", b"defg"])[:-1])
    (tmp_path / "b.pcap").write_bytes(capture_bytes([b"abc", b"d" * 30, b"e"], snap=20))
    assert {r.capture: r["count"] for r in pcap.read_captures(spark, str(tmp_path)).groupBy("capture").count().collect()} == {"a.pcap": 1, "b.pcap": 1}
    (tmp_path / "c.pcap").write_bytes(b"not a capture, whatever it says")
    with pytest.raises(Exception, match="not a capture"):
        pcap.read_captures(spark, str(tmp_path / "c.pcap")).collect()


def test_written_captures_come_back(spark, tmp_path):
    frames = [frame("10.0.0.1", "10.0.0.2", k, 80, load=b"x" * k) for k in range(1, 30)]
    rows = raw(spark, frames).union(raw(spark, frames[:5], "d.pcap")).orderBy(F.rand(1))
    pcap.write_captures(rows, str(tmp_path / "out"))
    back = pcap.read_captures(spark, str(tmp_path / "out")).orderBy("capture", "packet_no").collect()
    assert [bytes(r.data) for r in back] == frames + frames[:5]


def test_decoding(spark):
    good = [frame("192.168.1.100", "8.8.4.4", 5000, 443, 6, 18, b"zz"), frame("1.2.3.4", "5.6.7.8", 53, 9, 17, 0, b"q"), frame("1.1.1.1", "2.2.2.2", 0, 0, 1)]
    arp = b"\x01" * 12 + b"\x08\x06" + b"x" * 10
    bad = [b"short", good[0][:30], good[0][:40], good[0][:14] + b"\x46" + good[0][15:54], good[1][:14] + b"\x65" + good[1][15:]]
    got = decode.decode(raw(spark, [*good, arp, *bad])).orderBy("packet_no").collect()
    assert [r.ok for r in got] == [True, True, True, True, False, False, False, False, False]
    assert (got[0].src_ip_s, got[0].dst_ip_s, got[0].src_port, got[0].dst_port, got[0].tcp_flags, got[0].payload_offset, got[0].payload_length, got[0].ttl, got[0].seq, got[0].ack) == ("192.168.1.100", "8.8.4.4", 5000, 443, 18, 54, 2, 64, 1, 2)
    assert got[0].src_ip == 192 + 168 * 256 + 65536 + 100 * 16777216 and got[0].src_mac == "04:04:04:04:04:04"
    assert (got[1].has_udp, got[1].payload_offset, got[1].payload_length) == (True, 42, 1)
    assert (got[2].has_tcp, got[2].has_udp, got[2].protocol) == (False, False, 1)
    assert (got[3].has_ip, got[3].payload_offset, got[3].payload_length, got[3].ether_type) == (False, 14, 10, 0x0806)
    assert decode.transport_packets(raw(spark, [*good, arp, *bad])).count() == 2
    line = decode.dump(decode.transport_packets(raw(spark, good))).orderBy("packet_no").first()
    assert line.line == "#0 192.168.1.100:5000 -> 8.8.4.4:443 TCP [SYN ACK] len=2" and line.preview == "7a7a"


def test_names_and_addresses(spark):
    assert network.parse_ip("192.168.1.10") == 0x0A01A8C0 == network.parse_ip("-192.168.1.x10")
    assert network.parse_ip("999.0.0.0") == 999 and network.parse_ip("1.2.3.4.5") == 67305989
    row = spark.range(1).select(*[network.tcp_flags_name(F.lit(v)).alias(f"f{v}") for v in (0, 2, 18, 63)], network.protocol_name(F.lit(99)).alias("p"), network.format_ip(F.lit(0x0A01A8C0)).alias("ip")).first()
    assert (row.f0, row.f2, row.f18, row.f63, row.p, row.ip) == ("none", "SYN", "SYN ACK", "SYN ACK FIN RST PSH URG", "Unknown(99)", "192.168.1.10")


def test_tuple_hash_and_mixing(spark):
    rng = random.Random(0)
    rows = [tuple(rng.randrange(n) for n in (2**32, 2**32, 65536, 65536, 256)) for _ in range(200)] + [(0, 0, 0, 0, 0)]

    def plain(t):
        h = 0
        for v in t:
            h ^= (v + 0x9E3779B9 + (h << 6) + (h >> 2)) % 2**64
        return h

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    t = spark.createDataFrame(rows, "src_ip long, dst_ip long, src_port int, dst_port int, protocol int")
    h = network.five_tuple_hash(*(F.col(c) for c in t.columns))
    assert [(r.h, int(r.m)) for r in t.select(h.alias("h"), network.mix64(h).alias("m")).collect()] == [(plain(r), mixed(plain(r))) for r in rows]
    assert aggregates.shard_loads(t, 2, 3).agg(F.sum("packets")).first()[0] == len(rows)


HOSTS = {
    "": "Unknown", "www.youtube.com": "YouTube", "WWW.GOOGLE.COM": "Google", "scontent.fbcdn.net": "Facebook", "example.invalid": "HTTPS", "raw.githubusercontent.com": "GitHub", "yt3.ggpht.com": "YouTube", "abbot.com": "HTTPS",
    "tubing.net": "HTTPS", "pineapple.com": "HTTPS", "x.com": "Twitter/X", "t.co": "Twitter/X", "s3.amazonaws.com": "Amazon", "outlook.office365.com": "Microsoft", "www.bing.com": "Microsoft", "www.apple.com": "Apple", "us02web.zoom.us": "Zoom", "i.scdn.co": "Spotify", "fonts.gstatic.com": "Google",
}


def test_host_applications(spark):
    got = spark.createDataFrame([(h,) for h in HOSTS], "h string").select("h", apps.classify_host(F.col("h")).alias("a")).collect()
    assert {r.h: r.a for r in got} == HOSTS
    assert [r.n for r in spark.range(-1, 24).select(apps.app_name(F.col("id").cast("int")).alias("n")).collect()] == ["Unknown", *apps.APP_NAMES, "Unknown"]


def test_payload_names(spark):
    good = hello(b"a.example.com")
    cases = [
        (good, "a.example.com"), (good[:20], None), (b"", None), (None, None), (b"hello there, this isn't one", None), (hello(b"x.com", kind=1), None), (hello(b""), ""),
        (hello(b"b.org", struct.pack(">HHHBH", 0, 8, 6, 9, 3) + b"bad"), "b.org"), (good[:3] + b"\xff\xff" + good[5:], None), (b"\x16\x03\x05" + good[3:], None),
    ]
    assert [payload.server_name(b) for b, _ in cases] == [n for _, n in cases]
    rows = spark.createDataFrame([(k, b if b is None else bytearray(b)) for k, (b, _) in enumerate(cases)], "k int, b binary")
    assert [r.n for r in rows.orderBy("k").select("k", payload.tls_server_name("b").alias("n")).collect()] == [n for _, n in cases]
    assert payload.dns_name(question("www.example.org")) == "www.example.org" and payload.dns_name(question("a.b", 0x8100)) is None and payload.dns_name(question("a.b", count=0)) is None
    assert payload.dns_name(question("a")[:12] + b"\x03www\xc0\x04") == "www" and payload.dns_name(question("a")[:12] + b"\xc0\x04") is None
    assert payload.quic_name(b"\xc0" + b"\x00" * 9 + good + b"\x00" * 60) == "a.example.com" and payload.quic_name(b"\x40" + good) is None
    spark.udtf.register("tls_extensions", payload.TlsExtensions)
    assert [tuple(r) for r in spark.sql(f"select * from tls_extensions(unhex('{good.hex()}'))").collect()] == [(0, (b"\x00\x10\x00\x00\x0d" + b"a.example.com").hex())]


def test_http_hosts(spark):
    cases = [
        (b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n", "example.com"), (b"GET / HTTP/1.1\r\nX-Forwarded-Host: no\r\nhOsT:\t yes:80\r\n", "yes"), (b"POST / HTTP/1.1\r\nHost:\r\nHost: later\r\n", "later"),
        (b"BREW / HTTP/1.1\r\nHost: x\r\n", None), (b"GET / HTTP/1.1\r\n\r\nghost: in body", None), (b"GET /\nHost:z", "z"), (b"GET", None), (b"PUT /\rHost: :80", ""),
    ]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(cases)], "k int, b binary").orderBy("k")
    assert [r.h for r in rows.select("k", payload.http_host(F.col("b")).alias("h")).collect()] == [h for _, h in cases]


def test_domain_rules(spark):
    r = rules.Rules().block_domain("ads.example.com").block_domain("*.tiktok.com").block_domain("face*book.com").block_domain("[!a]x?.org")
    blocked = ["ADS.EXAMPLE.COM", "cdn.tiktok.com", "tiktok.com", "CDN.TIKTOK.COM", "facebook.com", "faceXbook.com", "bxy.org"]
    free = ["nottiktok.com", "tiktok.com.evil.net", "notabook.com", "", "axy.org", "ads.example.com.x"]
    got = spark.createDataFrame([(h,) for h in blocked + free], "h string").select("h", inspect.domain_blocked(F.col("h"), r).alias("b")).collect()
    assert {x.h for x in got if x.b} == set(blocked)
    rows = spark.createDataFrame([("1.1.1.1", 5, "HTTP", h) for h in blocked + free], "src_ip_s string, dst_port int, app string, name string")
    joined = inspect.block_reason_by_join(rows, r.table(spark)).collect()
    assert {x.name for x in joined if x.reason == "DOMAIN"} == set(blocked) and len(joined) == len(blocked + free)


def test_patterns_by_join_are_those_in_expressions(spark):
    patterns = ["*.co", "a*", "?b?.net", "*[x-z]*.org", "[!seq]og.*", "w[", "*long-name*", "*.x?.com", "*"]
    names = ["co", "a.co", "xaco", "abc", "aba.net", "aby.org", "dog.io", "sog.io", "w[", "my-long-name.de", "a.xy.com", "xy.com", "Ab.NET", "é.co"]
    rows = spark.createDataFrame([("1.1.1.1", 5, "HTTP", n) for n in names], "src_ip_s string, dst_port int, app string, name string")
    for p in patterns:
        r = rules.Rules().block_domain(p)
        want = {x.name for x in rows.where(inspect.domain_blocked(F.col("name"), r)).collect()}
        assert {x.name for x in inspect.block_reason_by_join(rows, r.table(spark)).collect() if x.reason} == want, p


def test_rule_order_and_files(spark, tmp_path):
    r = rules.Rules().block_ip("1.2.3.4").block_port(80).block_app("HTTP").block_domain("a.com")
    row = spark.createDataFrame([(network.parse_ip("1.2.3.4"), 80, "HTTP", "A.com")], "ip long, port int, app string, name string")
    reason = lambda x: row.select(inspect.block_reason(F.col("ip"), F.col("port"), F.col("app"), F.col("name"), x).alias("r")).first().r
    seen = [reason(r), reason(r := r.unblock_ip("1.2.3.4")), reason(r := r.unblock_port(80)), reason(r := r.unblock_app("HTTP")), reason(r.unblock_domain("a.com"))]
    assert seen == ["IP", "PORT", "APP", "DOMAIN", None]
    text = "[BLOCKED_IPS]\r\n10.0.0.1\r\n[BLOCKED_PORTS]\n80abc\noops\n[BLOCKED_APPS]\nNotAnApp\nNetflix\n[BLOCKED_DOMAINS]\n*.x\nads*\n"
    (tmp_path / "r.txt").write_text(text)
    got = rules.load_rules(spark, str(tmp_path / "r.txt"))
    assert (got.ports, got.apps, got.domains, got.ips, len(got.errors)) == ((80,), ("Netflix",), ("*.x", "ads*"), (network.parse_ip("10.0.0.1"),), 2)
    assert rules.parse_rules(got.save()) == got and got.stats()["blocked_domains"] == 2
    assert rules.load_rules(spark, str(tmp_path / "none.txt")) is None


# ---- flows ---------------------------------------------------------------------------------------------


def walk(packets, r):
    """The engine's decisions packet by packet, as a loop."""
    held, out = {}, []
    for p in packets:
        ends = sorted([(p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])])
        c = held.setdefault((ends[0], ends[1], p["protocol"]), {"state": "NEW", "app": "Unknown", "sni": "", "syn": 0, "sa": 0, "fin": 0})
        f = p["tcp_flags"] if p["protocol"] == 6 else 0
        if f & 2:
            c["sa" if f & 16 else "syn"] = 1
        if c["syn"] and c["sa"] and f & 16 and c["state"] == "NEW":
            c["state"] = "ESTABLISHED"
        c["fin"] |= f & 1
        if f & 4 or (c["fin"] and f & 16):
            c["state"] = "CLOSED"
        if c["state"] == "BLOCKED":
            out.append((True, c["state"], c["app"], c["sni"]))
            continue
        if c["state"] != "CLASSIFIED" and p["cand_app"] is not None:
            c.update(state="CLASSIFIED", app=p["cand_app"], sni=p["cand_name"])
        low = c["sni"].lower()
        drop = p["src_ip"] in r.ips or p["dst_port"] in r.ports or c["app"] in r.apps or bool(low) and (low in r.names or any(inspect.matches_pattern(low, x) for x in r.patterns))
        if drop:
            c["state"] = "BLOCKED"
        out.append((drop, c["state"], c["app"], c["sni"]))
    return out


def sequence(seed, n):
    rng, out = random.Random(seed), []
    loads = [b"", b"", hello(b"www.netflix.com"), hello(b"a.com"), b"GET / HTTP/1.1\r\nHost: b.org\r\n\r\n", question("c.net"), b"junk" * 20]
    for _ in range(n):
        a, b = ("10.0.0.%d" % rng.randrange(1, 3), rng.choice([1000, 1001])), ("9.9.9.9", rng.choice([443, 80, 53, 9001]))
        src, dst = (a, b) if rng.random() < 0.7 else (b, a)
        out.append(frame(src[0], dst[0], src[1], dst[1], rng.choice([6, 6, 17]), rng.choice([2, 18, 16, 24, 17, 4]), rng.choice(loads)))
    return out


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 16), (3, 5)])
def test_the_state_machine_matches_a_loop(spark, monkeypatch, seed, block):
    monkeypatch.setattr(flows, "BLOCK", block)
    r = rules.Rules().block_app("Netflix").block_domain("b.*").block_port(9001).block_ip("10.0.0.2")
    judged = flows.judged_packets(decode.transport_packets(raw(spark, sequence(seed, 150))), r).persist()
    rows = [x.asDict() for x in judged.orderBy("packet_no").collect()]
    v = flows.verdicts(judged, r)
    got = [(x.reason is not None, flows.STATES[x.state], x.app, x.name) for x in v.orderBy("packet_no").collect()]
    assert got == walk(rows, r)
    table = flows.engine_flows(judged, v).collect()
    assert sum(x.packets_in + x.packets_out for x in table) == 150 and sum(x.dropped for x in table) == sum(g[0] for g in got)
    judged.unpersist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 2, 18, 16, 24, 17, 4]), st.sampled_from([None, ("HTTP", "a"), ("DNS", "b")]), st.sampled_from([None, "APP"]), st.sampled_from([None, None, "IP"])), max_size=30))
def test_states_of_a_flow_only_depend_on_what_entered(packets):
    state = (flows.NEW, False, False, False, None, ("Unknown", ""))
    free = state[:5] + (None,)
    for p in packets:
        state, reason, _ = flows.advance(state, p)
        free, reason2, _ = flows.advance(free, p)
        assert state[:5] == free[:5] and reason == reason2 and (free[5] is None or free[5] == state[5])


@pytest.mark.parametrize("policy", ["working", "mt"])
def test_simple_policies_match_a_loop(spark, policy):
    r = rules.Rules().block_domain("netflix").block_ip("10.0.0.2")
    packets = decode.transport_packets(raw(spark, sequence(9, 200))).persist()
    got = [(x.app, x.dropped) for x in flows.simple_verdicts(packets, flows.simple_flows(packets, r, policy)).orderBy("packet_no").collect()]
    held, want = {}, []
    for p in packets.orderBy("packet_no").collect():
        body = bytes(p.data)[p.payload_offset :]
        c = held.setdefault((p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol), {"app": "Unknown", "sni": "", "done": False, "blocked": False})
        tcp = p.has_tcp or policy == "mt"
        name = payload.server_name(body) if tcp and p.dst_port == 443 and len(body) > 5 else None
        if name is None and tcp and p.dst_port == 80 and body.startswith(b"GET") and b"Host: b.org" in body:
            name = "b.org"
        if name and not c["done"]:
            c.update(sni=name, app="Netflix" if "netflix" in name else "HTTPS", done=True)
        if c["app"] == "Unknown" and 53 in (p.dst_port, p.src_port):
            c.update(app="DNS", done=True)
        elif c["app"] == "Unknown" and p.dst_port in (443, 80):
            c["app"] = "HTTPS" if p.dst_port == 443 else "HTTP"
        c["blocked"] = c["blocked"] or p.src_ip in r.ips or "netflix" in c["sni"]
        want.append((c["app"], c["blocked"]))
    assert got == want
    packets.unpersist()


def test_reports(spark):
    f = spark.createDataFrame([("c", "HTTP", "a", 1), ("c", "HTTP", "b", 2), ("c", "DNS", "b", 3), ("c", "Unknown", "", 4)], "capture string, app string, sni string, first_packet_no int")
    assert [(r.sni, r.n) for r in aggregates.top_names(f).orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    row = aggregates.classification(f).first()
    assert (row.percent, row.bar) == (75.0, "#" * 15)
    assert {r.app: r.n for r in aggregates.distribution(f, "app").collect()} == dict(Counter(["HTTP", "HTTP", "DNS", "Unknown"]))
