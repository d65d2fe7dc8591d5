"""Reports, signals, chunks, search, context, evaluation and documents against plain versions."""

import datetime
import ipaddress
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.operators import chunking, context, embedding, evaluation, report, search, signals
from flowloom.sources import knowledge
from flowloom.streaming.flows import flow_sessions

FLOW = "capture string, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, state string, app string, sni string, action string, packets_out long, packets_in long, bytes_out long, bytes_in long, syn_seen boolean, syn_ack_seen boolean, fin_seen boolean, first_packet_no long"


def wire(ip):
    return int.from_bytes(ipaddress.ip_address(ip).packed, "little")


def flow(k, src="10.0.0.1", dst="8.8.8.8", sport=None, dport=443, state="CLASSIFIED", sni="www.example.com", out=900, back=6400, action="FORWARD", capture="dir/c.pcap", proto=6, app="HTTPS"):
    return (capture, wire(src), wire(dst), sport or 50000 + k, dport, proto, state, app, sni, action, 8, 12, out, back, True, True, True, k)


def test_internal_addresses(spark):
    rng = random.Random(0)
    ips = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "192.0.0.8", "192.0.0.9", "100.64.0.1", "198.18.1.1", "224.0.0.5", "240.0.0.1", "0.1.2.3", "169.254.1.1", "203.0.113.9", "8.8.8.8", "255.255.255.255"]
    ips += [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(300)]
    got = spark.createDataFrame([(i, wire(i)) for i in ips], "s string, ip long").select("s", report.is_internal(F.col("ip")).alias("b")).collect()
    for r in got:
        a = ipaddress.ip_address(r.s)
        assert r.b == (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_unspecified), r.s


def test_pseudonyms(spark):
    def plain(n):
        out = ""
        while n >= 0:
            out, n = chr(97 + n % 26) + out, n // 26 - 1
        return "host_" + out

    numbers = [0, 25, 26, 27, 51, 52, 700, 701, 702, 703, 1400, 18277]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", report.pseudonym(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {n: plain(n) for n in numbers}


def test_reports_rank_cap_and_number(spark):
    rows = [flow(k, out=100 * (k % 7), dport=[443, 80, 53][k % 3]) for k in range(60)] + [flow(60, state="BLOCKED", sni="", action="DROP"), flow(61, sni="", out=10**6)]
    f = spark.createDataFrame(rows, FLOW)
    got = report.flow_records(f, limit=40).orderBy("flow_id").collect()
    best = sorted(rows, key=lambda r: (r[6] == "BLOCKED", bool(r[8]), r[12] + r[13]), reverse=True)[:40]
    best.sort(key=lambda r: (r[4], r[3], r[1]))
    assert [(r.flow_id, r.dst_port, r.src_port) for r in got] == [(k, r[4], r[3]) for k, r in enumerate(best)]
    assert {r.capture for r in got} == {"c.pcap"} and {(r.src_ip, r.dst_ip) for r in got} == {("host_a", "8.8.8.8")}
    note = report.notes(f, report.flow_records(f, limit=40).withColumn("capture", F.lit("dir/c.pcap")), "redact_private").first().notes
    assert len(note) == 2 and "62 flows" in note[0] and "1 internal" in note[1]
    assert {(r.src_ip, r.dst_ip) for r in report.flow_records(f, "full").collect()} == {("10.0.0.1", "8.8.8.8")} and {r.src_ip for r in report.flow_records(f, "none").collect()} == {None}


def test_pseudonyms_follow_first_use(spark):
    f = spark.createDataFrame([flow(0, "10.0.0.9", "10.0.0.1"), flow(1, "10.0.0.1", "10.0.0.5"), flow(2, "9.9.9.9", "10.0.0.9")], FLOW)
    got = [(r.src_ip, r.dst_ip) for r in report.flow_records(f).orderBy("flow_id").collect()]
    assert got == [("host_a", "host_b"), ("host_b", "host_c"), ("9.9.9.9", "host_a")]


def test_host_names(spark):
    cases = {"WWW.Example.COM": "www.example.com", "": None, "  \n": None, "!!!@@@###": "<invalid-hostname>", 'a"b{c}\nd e': "abcde", ".-x-.": "x", "é ": "<invalid-hostname>", None: None}
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", text.sanitize_hostname(F.col("s")).alias("h")).collect()
    assert {r.s: r.h for r in got} == cases
    long = spark.createDataFrame([("a" * 5000,)], "s string").select(F.length(text.sanitize_hostname(F.col("s")))).first()[0]
    assert long == 253


def test_text_functions(spark):
    rows = ["", "a", "aab", "x9f3kq2mz", "a.b"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", text.entropy(F.col("s")).alias("e"), text.parent_domain(F.lit("a.b.co.uk")).alias("p"), text.estimate_tokens(F.col("s")).alias("t")).collect()
    for r in got:
        n = len(r.s)
        assert abs(r.e - (-sum(c / n * math.log2(c / n) for c in Counter(r.s).values()) if n else 0)) < 1e-12 and r.t == math.ceil(n / 3.5) and r.p == "co.uk"
    out = spark.range(1).select(text.redact_secrets(F.lit("  key sk-abcdef123 and\n Bearer abc.def-123, password: hunter22 " + "Z" * 45 + " ok " + "w " * 300)).alias("r"), text.neutral_fences(F.lit("a==== b===== c======= d")).alias("f"), text.slug(F.lit("What, the X?")).alias("s")).first()
    assert out.r.startswith("key [redacted] and [redacted], [redacted] [redacted] ok w") and len(out.r) == 303
    assert out.f == "a==== b= = = = = c= = = = = = = d" and out.s == "what-the-x"


RECORD = "capture string, flow_id int, protocol string, dst_port int, server_name string, application string, state string, verdict string, bytes_out long, bytes_in long, syn_seen boolean, syn_ack_seen boolean, src_ip string"


def rec(k, proto="TCP", port=443, name="www.example.com", app="HTTPS", state="CLASSIFIED", verdict="FORWARD", out=900, back=6400, syn=True, ack=True, src="host_a", capture="c"):
    return (capture, k, proto, port, name, app, state, verdict, out, back, syn, ack, src)


def dns(k, name, out=80, back=180):
    return rec(k, "UDP", 53, name, "DNS", out=out, back=back, syn=False, ack=False)


CASES = {
    "tunnel": ([dns(k, f"{'q7x2' * 8}{k:02d}.evil.example", 6000, 120) for k in range(18)] + [rec(k) for k in range(18, 22)], {"dns_high_volume", "dns_high_cardinality", "dns_anomalous_label", "upload_asymmetry", "baseline_web_browsing"}),
    "browsing": ([rec(k, name=f"cdn{k}.example.com") for k in range(14)] + [rec(k, "UDP", 443, app="QUIC") for k in range(14, 18)] + [dns(k, "a.example.com") for k in range(18, 21)], {"baseline_web_browsing", "quic_present"}),
    "unknown": ([rec(k, name=None, app="Unknown") for k in range(9)] + [rec(k) for k in range(9, 14)], {"unknown_app_share", "tls_without_sni", "baseline_web_browsing"}),
    "scan": ([rec(k, port=p, ack=False, name=None) for k, p in enumerate([22, 25, 80, 110, 143, 443, 445, 993, 8080])], {"scan_port_fanout", "scan_half_open", "plaintext_http", "tls_without_sni", "baseline_web_browsing"}),
    "blocked": ([rec(0, verdict="DROP"), rec(1)], {"blocked_traffic_present", "baseline_web_browsing"}),
    "odd ports": ([rec(k, port=40000 + k) for k in range(5)], {"nonstandard_port_egress", "baseline_web_browsing"}),
}


def test_signals_of_labelled_cases(spark):
    rows = [(name, *r[1:]) for name, (records, _) in CASES.items() for r in records]
    got = signals.with_signal_ids(signals.signals(spark.createDataFrame(rows, RECORD))).orderBy("capture", "position").collect()
    assert {name: {r.signal for r in got if r.capture == name} for name in CASES} == {name: want for name, (_, want) in CASES.items()}
    half = next(r for r in got if r.capture == "scan" and r.signal == "scan_half_open")
    assert (half.severity, half.confidence, dict(half.evidence), half.flow_ids) == ("MEDIUM", 0.95, {"half_open_count": "9", "ratio": "1.0", "tcp_flow_count": "9"}, list(range(9)))
    parent = next(r for r in got if r.signal == "dns_high_cardinality")
    assert parent.evidence["top_parent_domain"] == "evil.example" and parent.evidence["top_parent_name_count"] == "18"
    assert all(r.signal_id.startswith(r.signal + "#") and len(r.signal_id) == len(r.signal) + 13 for r in got)
    for name in CASES:
        order = [(-signals.SEVERITY[r.severity], -r.confidence, r.signal) for r in got if r.capture == name]
        assert order == sorted(order)
    assert signals.signals(spark.createDataFrame([], RECORD)).count() == 0
    totals = spark.createDataFrame([("blocked", 7, 3)], "capture string, dropped_packets long, unknown_flows long")
    again = signals.signals(spark.createDataFrame([("blocked", *rec(1)[1:])], RECORD), totals).where("signal = 'blocked_traffic_present'").first()
    assert again.evidence["dropped_packets"] == "7" and again.evidence["blocked_flow_count"] == "0"


def test_profile(spark):
    rows = [rec(k, port=p) for k, p in enumerate([1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11])]
    got = signals.profile(spark.createDataFrame(rows, RECORD)).where("kind = 'port'").orderBy("position").collect()
    assert [(r.value, r.n) for r in got] == [("1", 2), ("2", 2), *((str(p), 1) for p in range(3, 11))]


def test_chunks_hold_the_text(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("w" * rng.randint(2, 9) for _ in range(n))
    body = "\n\n".join(words(rng.randint(20, 90)) + ". " + words(12) + "." for _ in range(20)) + "\n- " + "\n- ".join(words(8) for _ in range(30)) + "\n\n" + "z" * 3000
    for limit, overlap in ((1400, 200), (300, 60), (200, 0)):
        parts = chunking.split_text(body, limit, overlap)
        assert all(len(p) <= limit for p, _ in parts)
        bare = "".join(p[n:] for p, n in parts)
        assert "".join(bare.split()) == "".join(body.split())
        assert all(parts[k - 1][0].endswith(p[:n]) for k, (p, n) in enumerate(parts) if n)
    assert chunking.split_text(" short ") == [("short", 0)] and chunking.split_text("") == [("", 0)]
    rows = spark.createDataFrame([("doc", "Some Section", body, 1), ("d2", "S", None, 2)], "document_id string, section string, text string, kept int")
    got = chunking.chunks(rows).orderBy("document_id", "chunk_index").collect()
    assert {r.chunk_count for r in got if r.document_id == "doc"} == {len(chunking.split_text(body))} and got[0].kept == 2
    assert got[1].chunk_id == f"doc#some-section#00-{got[1].content_sha256[:12]}" and len({r.chunk_id for r in got}) == len(got)
    spark.udtf.register("chunk_text", chunking.ChunkText)
    assert spark.sql("select * from chunk_text('a b', 10, 2)").first().chunk == "a b"


def test_search_and_retrieval(spark):
    basis = np.vstack([np.eye(4), [[1, 1, 0, 0], [0, 0, 1, 1]]]) / np.array([1, 1, 1, 1, 2**0.5, 2**0.5])[:, None]
    index = spark.createDataFrame([(f"c{k}", f"d{k % 3}", v.tolist()) for k, v in enumerate(basis)], "chunk_id string, document_id string, vector array<double>")
    queries = spark.createDataFrame([("q1", [2.0, 0.0, 0.0, 0.0]), ("q2", [0.0, 0.0, 1.0, 1.0])], "label string, vector array<double>")
    hits = search.search(queries, index, 3)
    got = {(r.label, r.rank): (r.chunk_id, round(r.similarity, 6)) for r in hits.collect()}
    assert got == {("q1", 0): ("c0", 1.0), ("q1", 1): ("c4", 0.707107), ("q1", 2): ("c1", 0.0), ("q2", 0): ("c5", 1.0), ("q2", 1): ("c2", 0.707107), ("q2", 2): ("c3", 0.707107)}
    assert search.search(queries, index, 3, least=0.5).count() == 5 and search.search(queries, index, 0).count() == 0
    with pytest.raises(ValueError):
        search.search(queries, index, -1)
    with pytest.raises(ValueError):
        search.search(spark.createDataFrame([("z", [0.0] * 4)], "label string, vector array<double>"), index, 1)
    merged = search.merge(hits.where("similarity > 0")).join(index.select("chunk_id", "document_id"), "chunk_id")
    chosen = search.select_chunks(merged, final_k=3, per_document=1).orderBy("rank").collect()
    assert [r.chunk_id for r in chosen] == ["c0", "c5", "c4"] and dict(chosen[0].per_query) == {"q1": 1.0}
    kinds = spark.createDataFrame([(["a"], ["a", "b"]), (["c"], ["a"]), ([], ["a"]), (["a"], [])], "s array<string>, f array<string>")
    assert [tuple(r) for r in kinds.select(*search.affinity(F.col("s"), F.col("f"))).collect()] == [("declared", 0), ("undeclared", 2), ("unscoped", 1), ("unscoped", 1)]


def test_encoders(spark):
    chunks = chunking.chunks(spark.createDataFrame([("a", "s", "dns dns scan", "T", "k"), ("b", "s", "http", "T", "k")], "document_id string, section string, text string, title string, category string"))
    made = embedding.embed_chunks(chunks, embedding.KeywordEncoder(["dns", "http", "scan"]))
    rows = {r.chunk_id[0]: r for r in embedding.checked(made).collect()}
    assert np.allclose(rows["a"].vector, np.array([3, 1, 2]) / 14**0.5) and rows["a"].dimension == 3
    assert search.joined(chunks, made).count() == 2 and search.index_problems(made).count() == 0
    assert {r.problem for r in search.index_problems(made.union(made.withColumn("model_name", F.lit("x")))).collect()} == {"repeated id", "several models"}
    unit = embedding.statistics(embedding.embed_chunks(chunks, embedding.HashingEncoder(16))).first()
    assert unit.vectors == 2 and abs(unit.least_norm - 1) < 1e-9
    with pytest.raises(Exception, match="blank"):
        spark.createDataFrame([(" ",)], "t string").select(embedding.encode(F.col("t"), embedding.HashingEncoder())).collect()
    with pytest.raises(Exception, match="isn't the one"):
        search.joined(chunks.withColumn("content_sha256", F.lit("x")), made).collect()


def test_budget_passes_over_what_does_not_fit(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        n, used = 0, 10
        for rank in range(rng.randint(0, 9)):
            size = rng.choice([200, 700, 900, 1500, 2500])
            rows.append((f"g{g}", rank, f"k{rank}", size))
            total = used + size + len(str(n + 1)) + (2 if n else 0)
            reason = "max_items" if n >= 4 else "max_chars" if total > 3000 else "max_tokens" if math.ceil(total / 3.5) > 800 else None
            want[(f"g{g}", f"k{rank}")] = (None, reason) if reason else (n, None)
            if not reason:
                n, used = n + 1, total
    got = context.fit_budget(spark.createDataFrame(rows, "capture string, rank int, chunk_id string, size int"), max_tokens=800, overhead=10).collect()
    assert {(r.capture, r.chunk_id): (r.position, r.reason) for r in got} == want


def test_rendering(spark):
    taken = spark.createDataFrame([("c", 1, "d2", "S", "cat", 0.5, "d2 / S", [], "two"), ("c", 0, "d1", "S", "cat", 0.75, "d1 / S", ["x"], "one ===== fence")], "capture string, position int, document_id string, section string, category string, similarity double, citation string, matched array<string>, text string")
    block = context.render_block(taken).first()
    assert block.text.startswith("[K1]\nDocument: d1\nSection: S\nCategory: cat\nSimilarity: 0.7500\nCitation: d1 / S\nMatched signals: x\nText:\none = = = = = fence\n\n[K2]") and block.chars == len(block.text)
    records = spark.createDataFrame([("c", 1, True, None, "a|b"), ("c", 0, False, 5, "x")], "capture string, flow_id int, syn boolean, port int, name string")
    assert context.render_records(records, ["syn", "port", "name"]).first().text == "name|port|syn\nx|5|0\na\\|b||1"


def test_metrics(spark):
    ranking = spark.createDataFrame([("a", k + 1, i) for k, i in enumerate(["x", "y", "x", "z", "w"])] + [("b", 1, "q")], "case string, rank int, item string")
    relevant = spark.createDataFrame([("a", "y"), ("a", "w"), ("a", "n"), ("c", "m")], "case string, item string")
    m = {r.case: r for r in evaluation.metrics(ranking, relevant, ["case"], (1, 3)).collect()}
    assert (m["a"].hit_1, m["a"].hit_3, m["a"].recall_3, m["a"].precision_3, m["a"].reciprocal_rank) == (0.0, 1.0, 1 / 3, 1 / 3, 0.5)
    assert m["b"].hit_1 is None and m["b"].reciprocal_rank is None and (m["c"].recall_3, m["c"].precision_3, m["c"].reciprocal_rank) == (0.0, None, 0.0)
    ranked = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, False)], "case string, rank int, found boolean")
    sized = spark.createDataFrame([("a", 3), ("c", 1)], "case string, relevant long")
    assert {r.case: r for r in evaluation.judged_metrics(ranked, sized, ["case"], (1, 3)).collect()} == m
    mean = evaluation.means(evaluation.metrics(ranking, relevant, ["case"], (3,)), ["recall_3", "precision_3"]).first()
    assert abs(mean.recall_3 - 1 / 6) < 1e-12 and abs(mean.precision_3 - 1 / 3) < 1e-12 and mean.cases == 2
    kinds = evaluation.set_differences(relevant, ranking, ["case"], "item").collect()
    assert {(r.case, r.item): r.kind for r in kinds}[("a", "n")] == "missing" and {(r.case, r.item): r.kind for r in kinds}[("b", "q")] == "additional"


def test_candidates(spark):
    row = lambda c, supplied, tokens: (c, ["r1", "r2"], ["bad"], ["r1", "bad"], supplied, tokens, 1000, 100)
    cases = spark.createDataFrame([row("baseline", ["r1"], 4000), row("good", ["r1"], 3000), row("worse", [], 2000), row("noisy", ["r1", "bad"], 2000), row("large", ["r1", "r2"], 9000)], "candidate string, relevant array<string>, irrelevant array<string>, retrieved array<string>, supplied array<string>, prompt_tokens int, capture_tokens int, alongside_tokens int")
    a = evaluation.accounts(cases)
    first = a.where("candidate = 'worse'").first()
    assert (first.never_retrieved, first.lost_before_prompt, first.supplied_recall, first.supplied_precision, first.at_risk) == (["r2"], ["r1"], 0.0, None, False)
    got = {r.candidate: (r.ok, r.place) for r in evaluation.admissible(evaluation.candidates(a), "baseline").collect()}
    assert got == {"good": (True, 1), "worse": (False, None), "noisy": (False, None), "large": (False, None)}
    one = lambda r, p, i: spark.createDataFrame([(r, p, i)], "recall double, precision double, irrelevant int")
    verdict = lambda x, y: evaluation.decision(x, y).first().verdict
    assert [verdict(one(0.8, 0.5, 1), y) for y in (one(0.79, 0.6, 1), one(0.7, 0.6, 1), one(0.9, 0.4, 1), one(0.8, 0.5, 1), one(0.8, 0.5, 0), one(None, 0.5, 0))] == ["accept", "reject", "reject", "reject", "accept", "undecided"]


def test_sweeps(spark):
    merged = spark.createDataFrame([("a", "c1", "d1", 0.9), ("a", "c2", "d2", 0.5), ("a", "c3", "d1", 0.8), ("b", "c1", "d3", 0.4)], "case string, chunk_id string, document_id string, similarity double")
    relevant = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d3")], "case string, item string")
    grid = [{"name": "all"}, {"name": "high", "least": 0.7}, {"name": "one", "final_k": 1}]
    got = {r.setting: (r.recall, r.precision, r.cases) for r in evaluation.sweep(merged, relevant, grid, ["case"]).collect()}
    assert got == {"all": (1.0, 1.0, 2), "high": (0.25, 1.0, 2), "one": (0.75, 1.0, 2)}
    assert evaluation.recommended(evaluation.sweep(merged, relevant, grid, ["case"]), 0.9).first().setting == "all"


def test_candidates_by_cases(spark):
    rng = random.Random(8)
    grid = [
        {"name": "base", "per_query": 4}, {"name": "narrow", "per_query": 2, "per_document": 1, "least": 0.4, "max_items": 2}, {"name": "long", "per_query": 6, "final_k": 5, "max_chars": 6000, "max_tokens": 1600},
        {"name": "open", "per_query": 6, "per_document": None, "final_k": 12, "max_items": 99, "max_chars": None, "max_tokens": None}, {"name": "none", "least": 2.0, "per_query": 6},
    ]
    size = {c: rng.choice([150, 400, 900, 1400]) for c in range(30)}
    hits = [(case, f"q{q}", f"c{c:02d}", f"d{c % 7}", rng.choice([0.2, 0.5, 0.5, rng.random()]), r, size[c]) for case in range(12) for q in range(3) for r, c in enumerate(rng.sample(range(30), 6))]
    labels = [(case, f"d{k}", rng.random() < 0.5) for case in range(14) for k in range(7) if rng.random() < 0.7]
    got = {(r.candidate, r.case): r for r in evaluation.candidate_cases(spark.createDataFrame(hits, "case int, label string, chunk_id string, document_id string, similarity double, rank int, size int"), spark.createDataFrame(labels, "case int, document_id string, relevant boolean"), grid, "case").collect()}
    assert len(got) == 5 * len({c for c, _, _ in labels})
    for s in grid:
        s = {"final_k": 8, "per_document": 2, "least": None, "max_items": 4, "max_chars": 3000, "max_tokens": 900, **s}
        for case in {c for c, _, _ in labels}:
            best = {}
            for g, _, c, d, sim, r, n in hits:
                if g == case and r < s["per_query"]:
                    best[c] = (max(sim, best.get(c, (0,))[0]), d, n)
            ranked, per = [], Counter()
            for c, (sim, d, n) in sorted(best.items(), key=lambda x: (-round(x[1][0], 12), x[0])):
                if (s["least"] is None or sim >= s["least"]) and (s["per_document"] is None or per[d] < s["per_document"]):
                    per[d] += 1
                    ranked.append((d, n))
            ranked, used, inside, chars = ranked[: s["final_k"]], 0, [], 0
            for d, n in ranked:
                total = used + n + len(str(len(inside) + 1)) + (2 if inside else 0)
                if len(inside) < s["max_items"] and total <= (s["max_chars"] or 10**9) and math.ceil(total / 3.5) <= (s["max_tokens"] or 10**9):
                    used, chars = total, chars + n
                    inside.append(d)
            row = got[(s["name"], case)]
            assert (row.retrieved, row.supplied, row.supplied_chars) == (sorted({d for d, _ in ranked}), sorted(set(inside)), chars)
            assert row.relevant == sorted(d for c, d, ok in labels if c == case and ok) and row.irrelevant == sorted(d for c, d, ok in labels if c == case and not ok)
    for bad in ([], [{"name": "a"}, {"name": "a"}], [{"name": "a", "top": 1}]):
        with pytest.raises(ValueError):
            evaluation.by_settings(spark.range(1), bad)


def test_texts_of_captures(spark):
    totals = spark.createDataFrame([("a", 3, 300, 2, 1, 1, 2), ("b", 0, 0, 0, 0, 0, 0)], "capture string, total_packets long, total_bytes long, tcp_packets long, udp_packets long, forwarded_packets long, dropped_packets long")
    rows = [("a", "HTTPS", "x" * 40, 5), ("a", "HTTPS", "y.example", 2), ("a", "DNS", "y.example", 9), ("a", "Unknown", "", 1)]
    got = {r.capture: r.text for r in report.capture_texts(totals, spark.createDataFrame(rows, "capture string, app string, sni string, first_packet_no long")).collect()}
    assert got["b"] == "b: 0 packets, 0 bytes, 0 TCP, 0 UDP, 0 forwarded, 0 dropped (0.00%)"
    assert got["a"].split("\n") == [
        "a: 3 packets, 300 bytes, 2 TCP, 1 UDP, 1 forwarded, 2 dropped (66.67%)", f"  {'HTTPS':<16}{2:>8}   50.0%  {'#' * 10}", f"  {'DNS':<16}{1:>8}   25.0%  #####", f"  {'Unknown':<16}{1:>8}   25.0%  #####",
        f"  {'y.example':<36}{2:>6}", f"  {'x' * 32 + '...':<36}{1:>6}",
    ]


GOOD = "---\nid: dns-notes\ntitle: \"Names\"\ncategory: basics\nversion: 1.0\n# a comment\nkeywords:\n  - dns\n  - names\nmitre: []\n---\n## One\nfirst\n\n## Two\nsecond\n"


def test_knowledge_documents(spark, tmp_path):
    bad = {
        "no-fence": "id: x\n", "open": "---\nid: open\n", "tabs": "---\nid:\ttabs\n---\n", "inline": "---\nid: inline\nkeywords: [a, b]\n---\n", "twice": "---\nid: twice\nid: twice\n---\n", "renamed": GOOD,
        "missing": GOOD.replace("dns-notes", "missing").replace("## Two\nsecond\n", ""), "hollow": GOOD.replace("dns-notes", "hollow").replace("second", ""), "version": GOOD.replace("dns-notes", "version").replace("1.0", "v1"), "misfiled": GOOD.replace("dns-notes", "misfiled").replace("basics", "other"),
    }
    (tmp_path / "basics").mkdir()
    for name, body in {**bad, "dns-notes": GOOD}.items():
        (tmp_path / "basics" / f"{name}.md").write_text(body)
    docs = knowledge.read_documents(spark, str(tmp_path), ["One", "Two"], ["basics"])
    rows = docs.collect()
    assert {r.id for r in rows if r.problem is None} == {"dns-notes"} and sum(r.problem is not None for r in rows) == len(bad)
    sound = next(r for r in rows if r.problem is None)
    assert sound.title == "Names" and dict(sound.lists) == {"keywords": ["dns", "names"], "mitre": []}
    assert [(r.section, r.text) for r in knowledge.sections_of(docs).orderBy("section_index").collect()] == [("One", "first"), ("Two", "second")]


def test_sessions_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, start + datetime.timedelta(seconds=s), 10) for k, s in enumerate([0, 1, 2, 100, 350, 360, 700, 701, 5000, 5001])]
    frame = spark.createDataFrame(rows, "user int, event_ts timestamp, frame_len int")
    batch = {tuple(r) for r in flow_sessions(frame, ["user"]).collect()}
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))  # one trigger; nothing of it is late
    late = spark.createDataFrame([(9, start + datetime.timedelta(days=2), 1)], frame.schema)
    stream = flow_sessions(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*")), ["user"], late="1 hour")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        late.write.parquet(str(tmp_path / "in2"))
        query.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from sessions").collect()} == batch
    finally:
        query.stop()
