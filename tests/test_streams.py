"""Flows that end when idle: the stream's equal the batch's, whatever the micro-batches."""

import random

import pytest
from pyspark.sql import functions as F
from test_captures import frame, raw

from flowloom.operators import decode, flows
from flowloom.sources.rules import Rules
from flowloom.streaming import states

RULES = Rules().block_port(9001).block_app("HTTP")


def timed_packets(spark, seed: int, n: int):
    """Packets of a few flows a minute or five apart, with names and blocked ports."""
    rng = random.Random(seed)
    frames, times, now = [], [], 0
    for _ in range(n):
        now += rng.choice([1, 20, 150, 299, 300, 301, 302])
        client, port = f"10.0.0.{rng.randrange(3)}", rng.choice([443, 80, 9001])
        there = rng.random() < 0.6
        load = b"GET / HTTP/1.1\r\nHost: a.example.com\r\n\r\n" if port == 80 and there and rng.random() < 0.5 else b"x" * rng.randrange(40)
        src, dst = (client, "8.8.8.8") if there else ("8.8.8.8", client)
        frames.append(frame(src, dst, 5000 if there else port, port if there else 5000, 6, rng.choice([2, 18, 16, 24, 17, 4]), load))
        times.append(1_700_000_000_000_000 + now * 1_000_000 + rng.choice([0, 0, 999_999]))
    stamps = spark.createDataFrame(list(enumerate(times)), "packet_no long, us long").withColumn("event_ts", F.timestamp_micros("us")).drop("us")
    return states.timed_packets(decode.transport_packets(raw(spark, frames)).join(stamps, "packet_no"), RULES)


def plainly(timed) -> list:
    """Flows packet by packet."""
    out, held = [], {}
    for r in sorted(timed.withColumn("us", F.unix_micros("event_ts")).collect(), key=lambda r: r.packet_no):
        key = tuple(r[k] for k in flows.KEY)
        f = held.get(key)
        if f is not None and (r.us - f["ended"]) // 1_000_000 > states.IDLE:
            out.append(f)
            f = None
        if f is None:
            f = held[key] = {"key": key, "started": r.us, "first": r.packet_no, "state": flows._first(RULES), "n": 0, "dropped": 0}
        f["state"], reason, _ = flows.advance(f["state"], (r.tcp_flags, None if r.cand_app is None else (r.cand_app, r.cand_name), r.cand_reason, r.own_reason))
        f.update(ended=r.us, n=f["n"] + 1, dropped=f["dropped"] + (reason is not None), last=r.packet_no)
    return sorted((*f["key"], f["started"], f["ended"], flows.STATES[f["state"][0]], *f["state"][5], f["n"], f["first"], f["last"], f["dropped"]) for f in [*out, *held.values()])


def rows_of(found) -> list:
    got = found.withColumns({c: F.unix_micros(c) for c in ("started", "ended")}).collect()
    return sorted((*(r[k] for k in flows.KEY), r.started, r.ended, r.state, r.app, r.sni, r.packets_out + r.packets_in, r.first_packet_no, r.last_packet_no, r.dropped) for r in got)


@pytest.mark.parametrize("block", [8192, 4])
def test_batch_flows_are_cut_where_idle(spark, monkeypatch, block):
    for module in (states, flows):
        monkeypatch.setattr(module, "BLOCK", block)
    timed = timed_packets(spark, 1, 120)
    want = plainly(timed)
    assert rows_of(states.ended_flows(timed, RULES)) == want and len(want) > 12


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    """Slices overlap by a few packets and are shuffled; the stream is stopped and started again between them."""
    timed = timed_packets(spark, 2, 180).cache()
    high = timed.agg(F.max(F.unix_micros("event_ts"))).first()[0]
    for k in range(3):
        part = timed.where(F.floor((F.col("packet_no") + F.col("packet_no") % 4) / 61) == k).orderBy(F.rand(k)).repartition(2)
        part.write.mode("append").parquet(f"{tmp_path}/packets")
        found = states.run_stream(spark, f"{tmp_path}/packets", timed.schema, RULES, str(tmp_path), files=[1, 9, 1][k], late="4 hours")
    got, all_ = rows_of(found), plainly(timed)
    told = lambda rows: [f for f in rows if f[7] < high - (4 * 3_600 + 302) * 1_000_000]
    assert told(got) == told(all_) and set(got) <= set(all_) and len(told(got)) > 15


def test_blocks_are_dealt_out_after_all_joins(spark):
    """The walk's rows come from a shuffle of their own: a join's may be changed at run time, and blocks would be walked in pieces."""
    packets = spark.range(0).selectExpr("'c' capture", "id lo_ip", "1 lo_port", "id hi_ip", "1 hi_port", "6 protocol", "id block", "id packet_no", "2 tcp_flags", "'' cand_app", "'' cand_name", "'' cand_reason", "'' own_reason")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flows.verdicts(packets.localCheckpoint(), RULES)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    walk = next(k for k, line in enumerate(plan) if "MapInArrow" in line)
    assert "Sort [" in plan[walk + 1] and "Exchange hashpartitioning" in plan[walk + 2] and "REPARTITION_BY_COL" in plan[walk + 2]


def test_only_long_flows_are_summarised(spark, monkeypatch):
    """Flows of few packets that lie far apart are walked as they are; summaries of all their blocks cost far more than the walk."""
    monkeypatch.setattr(flows, "BLOCK", 40)
    made = spark.sparkContext.accumulator(0)
    real = flows._summaries(RULES)

    def counted(batches):
        for batch in real(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(flows, "_summaries", lambda rules: counted)
    packets = spark.range(500).selectExpr("'c' capture", "1L lo_ip", "int(if(id % 5 = 0, id % 25, 99)) lo_port", "2L hi_ip", "1 hi_port", "6 protocol", "id div 40 block", "id packet_no", "24 tcp_flags", "string(null) cand_app", "string(null) cand_name", "string(null) cand_reason", "if(id = 300, 'PORT', null) own_reason")
    got = {r.packet_no: r.reason for r in flows.verdicts(packets, RULES).collect()}
    assert got == {k: "PORT" if k == 300 else "FLOW" if k > 300 and (k % 25 == 0) else None for k in range(500)}
    assert made.value == 13  # the blocks of the one long flow


def test_stream_calls_python_for_shards_not_flows(spark, tmp_path):
    """However many flows there are, Python is called for shards; rows equal the batch's."""
    assert states.SHARDS <= 512
    n = 4000
    packets = spark.range(n).selectExpr("'c' capture", "1L lo_ip", "int(id % 1500) lo_port", "2L hi_ip", "1 hi_port", "6 protocol", "0L block", "id packet_no", "24 tcp_flags", "string(null) cand_app", "string(null) cand_name", "string(null) cand_reason", "if(id % 7 = 0, 'PORT', null) own_reason", "60 frame_len",
        "1L src_ip", "int(id % 1500) src_port", "2L dst_ip", "1 dst_port", "string(null) cand_kind", "timestamp_micros(1700000000000000 + id * 1000000) event_ts", "true is_lo")
    packets.write.parquet(f"{tmp_path}/packets")
    found = states.run_stream(spark, f"{tmp_path}/packets", packets.schema, RULES, str(tmp_path), files=1000, late="1 second", idle=300)
    high = (1_700_000_000 + n - 1) * 1_000_000
    told = lambda rows: [f for f in rows if f[7] < high - 310 * 1_000_000]
    got = rows_of(found)
    assert told(got) == told(rows_of(states.ended_flows(packets, RULES))) and len(told(got)) > 3000
