"""Whole plans over a rebuilt sample capture: 77 packets in 27 flows."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_captures import capture_bytes, frame, hello, question

from flowloom.__main__ import main
from flowloom.config import Settings
from flowloom.operators import answers
from flowloom.operators.embedding import KeywordEncoder
from flowloom.plans import pipeline
from flowloom.sources.pcap import read_captures
from flowloom.sources.rules import Rules

HOSTS = "www.google.com www.youtube.com www.facebook.com www.instagram.com twitter.com www.amazon.com www.netflix.com github.com discord.com zoom.us web.telegram.org www.tiktok.com open.spotify.com www.cloudflare.com www.microsoft.com www.apple.com".split()


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    me, out, port = "192.168.1.100", [], iter(random.Random(1).sample(range(49152, 65535), 60))
    for k, host in enumerate(HOSTS):
        p, server = next(port), f"142.250.1.{k + 1}"
        out += [frame(me, server, p, 443, 6, 2), frame(server, me, 443, p, 6, 18), frame(me, server, p, 443, 6, 16), frame(me, server, p, 443, 6, 24, hello(host.encode()))]
    for k, host in enumerate(["example.com", "httpbin.org"]):
        p = next(port)
        out += [frame(me, f"93.184.216.{k + 1}", p, 80, 6, 2), frame(me, f"93.184.216.{k + 1}", p, 80, 6, 24, f"GET / HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())]
    out += [frame(me, "8.8.8.8", next(port), 53, 17, 0, question(h)) for h in ["www.google.com", "www.youtube.com", "api.github.com", "example.com"]]
    out += [frame("192.168.1.50", "172.217.0.100", next(port), 443, 6, 2) for _ in range(5)]
    root = tmp_path_factory.mktemp("capture")
    (root / "sample.pcap").write_bytes(capture_bytes(out))
    return root, out


def test_filtering_the_sample(spark, sample, tmp_path):
    root, packets = sample
    made = pipeline.filter_captures(spark, str(root / "sample.pcap"), str(tmp_path / "out"), Rules().block_app("Netflix"))
    t = made.totals.first()
    assert (t.total_packets, t.tcp_packets, t.udp_packets, t.forwarded_packets, t.dropped_packets) == (77, 73, 4, 76, 1)
    assert made.flows.count() == 27 and made.flows.where("state = 'BLOCKED' and app = 'Netflix' and action = 'DROP'").count() == 1
    left = [bytes(r.data) for r in read_captures(spark, str(tmp_path / "out")).orderBy("packet_no").collect()]
    assert left == [p for p in packets if b"netflix" not in p]
    assert struct.unpack("<I", next((tmp_path / "out").glob("*.pcap")).read_bytes()[:4])[0] == 0xA1B2C3D4
    text = pipeline.report_text(made)
    assert "77 packets" in text and "1 dropped (1.30%)" in text and "YouTube" in text


def test_the_command_line(spark, sample):
    assert "0 dropped" in main([str(sample[0] / "sample.pcap"), "--block-port", "9"])


KNOWLEDGE = [("dns-notes", "basics", "DNS", "About", "dns lookups are usual. " * 20), ("http-notes", "basics", "HTTP", "About", "http without encryption shows all of it."), ("scan-notes", "threats", "Scans", "About", "scan of a port by one host.")]


def test_explaining_the_sample(spark, sample):
    made = pipeline.judge(read_captures(spark, str(sample[0])), Rules())
    docs = spark.createDataFrame(KNOWLEDGE, "document_id string, category string, title string, section string, text string")
    answer = '```json\n{"risk": "low", "summary": "Two flows use HTTP [K1], 77 of 5 numbers.", "flow_ids": [0, 99], "references": ["K1"]}\n```'
    x = pipeline.explain(made, docs, KeywordEncoder(["dns", "http", "scan", "port"]), lambda: answers.CannedClient([answers.ClientError("busy", True), answer]))
    fired = {r.signal for r in x.signals.collect()}
    assert {"plaintext_http", "tls_without_sni", "baseline_web_browsing"} <= fired and not fired & {"dns_anomalous_label", "scan_port_fanout", "upload_asymmetry", "blocked_traffic_present"}
    assert {r.label for r in x.queries.collect()} == {f"signal:{s}" for s in fired} | {"capture"}
    assert x.excerpts.where("position = 0").count() == 1
    row = x.answers.first()
    assert (row.status, row.risk, row.unknown_flows, row.unknown_references) == ("ok", "low", [99], [])


def test_answers_that_are_refused(spark):
    rows = spark.createDataFrame([("c", None, "1|2")], "capture string, knowledge string, flows string")
    records, taken = spark.createDataFrame([("c", 0)], "capture string, flow_id int"), spark.createDataFrame([], "capture string, position int")

    def status(client, limit=None):
        return answers.checked(answers.parsed(answers.ask(rows, client, limit)), records, taken).first().status

    assert status(answers.CannedClient(['{"risk": "x", "summary": "y", "references": ["K1"]}'])) == "refused"
    assert status(answers.CannedClient(["what?"])) == "unreadable"
    assert status(answers.CannedClient([answers.ClientError("rejected", False)])) == "rejected"
    assert status(answers.CannedClient(["{}"]), limit=3) == "too_large"


def test_retries():
    waits = []
    client = answers.CannedClient([answers.ClientError("busy", True)] * 3 + ["yes"])
    assert answers.complete(client, [], sleep=waits.append) == ("ok", "yes") and [round(w / v, 0) for w, v in zip(waits, (0.5, 1, 2))] == [1, 1, 1]
    assert answers.complete(answers.CannedClient([answers.ClientError("bad", False)]), [], sleep=waits.append) == ("bad", None) and len(waits) == 3
    assert answers.failure_text("Error", 429, "rate_limit") == "Error; HTTP 429; code=rate_limit" and answers.failure_text("Error", True, "x y") == "Error"


def test_queries_hold_nothing_of_a_capture(spark):
    rows = spark.createDataFrame([("seen www.evil.example",)], "t string")
    with pytest.raises(Exception, match="holds text of a capture"):
        rows.select(answers.clean_query(F.col("t"))).collect()
    with pytest.raises(Exception, match="prefix already"):
        rows.select(answers.with_prefix(answers.with_prefix(F.col("t")))).collect()


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# x\nFLOWLOOM_API_KEY='abcdefghijkl'\nFLOWLOOM_MAX_CHARS=off\nFLOWLOOM_MAX_FLOWS=5\n")
    s = Settings.from_env({"FLOWLOOM_MAX_FLOWS": "7"}, str(tmp_path / "env"))
    assert (s.max_flows, s.max_chars, s.max_items) == (7, None, 4) and s.shown()["api_key"] == "ab...kl" and "abcdef" not in repr(s)
    with pytest.raises(ValueError):
        Settings.from_env({"FLOWLOOM_ADDRESS_MODE": "x"})
