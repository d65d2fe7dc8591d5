"""Flows: counters by plain aggregation, and the sequential per-flow state.

Counters (packets, bytes, directions, opener) are hash aggregates with partial sums.
The engine policy's state machine depends on the order of a flow's packets. It is walked in packet order
over streams of sorted rows, so memory doesn't grow with a flow. A long flow (of over BLOCK packets) isn't one task's work: it is cut into blocks of BLOCK packet numbers, each block is
summarised as a function of the state that enters it (few states are possible, and they soon coincide),
the summaries of a flow are chained, and the blocks are walked in parallel from their entering states.

The `working` and `mt` policies only ever move forward, so there the state at a packet follows from the first packet that names
the flow: they are plain aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.network import ACK, FIN, RST, SYN, TCP, canonical, keeps_direction
from ..sources.rules import Rules
from .inspect import block_reason, domain_blocked, inspect, name_contains

KEY = ["capture", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
TUPLE = ["src_ip", "src_port", "dst_ip", "dst_port"]
#: Packet numbers of a capture that one block spans.
BLOCK = 8192

NEW, ESTABLISHED, CLASSIFIED, BLOCKED, CLOSED = range(5)
STATES = ["NEW", "ESTABLISHED", "CLASSIFIED", "BLOCKED", "CLOSED"]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds lo_ip, lo_port, hi_ip and hi_port, the same for both directions."""
    return packets.select("*", *canonical())


def counters(packets: DataFrame) -> DataFrame:
    """One row per flow: the opener's tuple, packets and bytes each way, flag sightings, first packet.

    Both directions are counted first; which of them is outbound is known once the first packet's direction is. All buffers are
    numbers, so this is a hash aggregate.
    """
    is_lo = keeps_direction(*(F.col(c) for c in TUPLE))
    flag = lambda bit: F.coalesce(F.col("tcp_flags"), F.lit(0)).bitwiseAND(F.lit(bit)) != 0
    by = packets.groupBy(*KEY).agg(
        F.min_by(is_lo, "packet_no").alias("opened_lo"),
        F.count_if(is_lo).alias("lo_packets"), F.count_if(~is_lo).alias("hi_packets"),
        F.sum(F.when(is_lo, F.col("frame_len")).otherwise(0)).alias("lo_bytes"), F.sum(F.when(is_lo, 0).otherwise(F.col("frame_len"))).alias("hi_bytes"),
        F.bool_or(flag(SYN) & ~flag(ACK)).alias("syn_seen"), F.bool_or(flag(SYN) & flag(ACK)).alias("syn_ack_seen"), F.bool_or(flag(FIN)).alias("fin_seen"),
        F.min("packet_no").alias("first_packet_no"), F.max("packet_no").alias("last_packet_no"),
    )
    way = lambda lo, hi: F.when(F.col("opened_lo"), F.col(lo)).otherwise(F.col(hi))
    opener = [way("lo_ip", "hi_ip").alias("src_ip"), way("lo_port", "hi_port").alias("src_port"), way("hi_ip", "lo_ip").alias("dst_ip"), way("hi_port", "lo_port").alias("dst_port")]
    out = [way("lo_packets", "hi_packets").alias("packets_out"), way("hi_packets", "lo_packets").alias("packets_in"), way("lo_bytes", "hi_bytes").alias("bytes_out"), way("hi_bytes", "lo_bytes").alias("bytes_in")]
    return by.select(*KEY, *opener, *out, "syn_seen", "syn_ack_seen", "fin_seen", "first_packet_no", "last_packet_no")


# ---- the engine policy's state machine ---------------------------------------------------------------
# A state is (phase, syn, syn_ack, fin, named, class): `named` tells whether the class in force is blocked by an
# application or domain rule (its reason or None); `class` is (application, name), or None for what the block began with.


def advance(state: tuple, packet: tuple) -> tuple[tuple, str | None, bool]:
    """(next state, drop reason or None, whether this packet named the flow).

    packet: (tcp_flags or None, candidate class or None, candidate's rule reason, the packet's own IP or PORT reason).
    The order is that of the engine: TCP flags first, which may close a named or blocked flow; a blocked flow drops; a flow that isn't named takes
    the packet's candidate; then rules, the packet's own before the class's.
    """
    phase, syn, syn_ack, fin, named, held = state
    flags, candidate, candidate_reason, own_reason = packet
    if flags is not None:
        if flags & SYN:
            syn, syn_ack = syn or not flags & ACK, syn_ack or bool(flags & ACK)
        if phase == NEW and syn and syn_ack and flags & ACK:
            phase = ESTABLISHED
        fin = fin or bool(flags & FIN)
        if flags & RST or (fin and flags & ACK):
            phase = CLOSED
    if phase == BLOCKED:
        return (phase, syn, syn_ack, fin, named, held), "FLOW", False
    told = candidate is not None and phase != CLASSIFIED
    if told:
        phase, named, held = CLASSIFIED, candidate_reason, candidate
    reason = own_reason or named
    return (BLOCKED if reason else phase, syn, syn_ack, fin, named, held), reason, told


_PACKET = ["packet_no", "tcp_flags", "cand_app", "cand_name", "cand_reason", "own_reason"]
_BLOCK_KEY = [*KEY, "block"]


def judged_packets(packets: DataFrame, rules: Rules, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packets with all that the state machine asks of them, and columns to keep; payloads are left behind."""
    p = with_flow_key(inspect(packets))
    own = block_reason(F.col("src_ip"), F.col("dst_port"), F.lit(None).cast("string"), F.lit(None).cast("string"), rules)
    of_class = F.when(F.col("cand_app").isin(*rules.apps) if rules.apps else F.lit(False), "APP").when(domain_blocked(F.col("cand_name"), rules), "DOMAIN")
    p = p.withColumns({"own_reason": own, "cand_reason": of_class, "block": F.floor(F.col("packet_no") / BLOCK).cast("long"), "tcp_flags": F.when(F.col("protocol") == TCP, F.col("tcp_flags"))})
    return p.select(*_BLOCK_KEY, *_PACKET, "cand_kind", "frame_len", *TUPLE, *keep)


def _first(rules: Rules) -> tuple:
    """The state of a flow before its first packet: unnamed, which a rule may block too."""
    return (NEW, False, False, False, "APP" if "Unknown" in rules.apps else None, ("Unknown", ""))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[tuple], bool]]:
    """(key, rows, whether the key starts here) of consecutive rows with the same key; long runs come in pieces."""
    before = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
        rows = list(zip(*(batch.column(c).to_pylist() for c in _PACKET)))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                yield keys[start], rows[start:k], keys[start] != before
                before, start = keys[start], k


def _packet(row: tuple) -> tuple:
    return row[1], None if row[2] is None else (row[2], row[3]), row[4], row[5]


def _ordered(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key, "packet_no")


def _summaries(rules: Rules):
    """For each block: every state that may enter it and the state that then leaves it."""
    entering = [(p, s, a, f, n, None) for p in range(5) for s in (False, True) for a in (False, True) for f in (False, True) for n in (None, "APP", "DOMAIN")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, {}

        def out():
            leaves = [at[s] for s in entering]
            flat = [(e[:5], v[:5], v[5]) for e, v in zip(entering, leaves) if e[:5] != v[:5] or v[5] is not None]
            return pa.RecordBatch.from_pydict(
                {**{k: [v] for k, v in zip(_BLOCK_KEY, held)}, "moves": pa.array([[json.dumps(x) for x in flat]], pa.list_(pa.string()))},
                schema=pa.schema([(k, pa.string() if k == "capture" else pa.int32() if k in ("lo_port", "hi_port", "protocol") else pa.int64()) for k in _BLOCK_KEY] + [("moves", pa.list_(pa.string()))]),
            )

        for key, rows, new in _runs(batches, _BLOCK_KEY):
            if new:
                if held is not None:
                    yield out()
                held, at = key, {s: s for s in entering}
            for row in rows:
                moved = {s: advance(s, _packet(row))[0] for s in set(at.values())}
                at = {e: moved[s] for e, s in at.items()}
        if held is not None:
            yield out()

    return run


def _chain(rules: Rules):
    """The state that enters each block of a flow, from the flow's block summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, state = None, None
        for batch in batches:
            states = []
            for *key, _, moves in zip(*(batch.column(c).to_pylist() for c in [*_BLOCK_KEY, "moves"])):
                if key != flow:
                    flow, state = key, _first(rules)
                states.append(json.dumps(state))
                for text in moves:
                    before, after, held = json.loads(text)
                    if tuple(before) == tuple(state[:5]):
                        state = (*after, held if held is not None else state[5])
                        break
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in _BLOCK_KEY), pa.array(states, pa.string())], names=[*_BLOCK_KEY, "entering"])

    return run


_VERDICT = "capture string, lo_ip long, lo_port int, hi_ip long, hi_port int, protocol int, block long, packet_no long, reason string, named boolean, state int, app string, name string"


def _walk(rules: Rules):
    """Walks blocks; a row with `entering`, which comes before its block's packets, tells the state in which the block is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = state = None
        for batch in batches:
            entering = batch.column("entering").to_pylist()
            out, at = [], 0
            for key, rows, _ in _runs(iter([batch]), _BLOCK_KEY):
                if key != held_key:
                    held_key, state = key, _first(rules)
                for row in rows:
                    told, at = entering[at], at + 1
                    if told is not None:
                        state = tuple(json.loads(told))
                        continue
                    state, reason, named = advance(state, _packet(row))
                    out.append((*key, row[0], reason, named, state[0], *state[5]))
            columns = list(zip(*out)) if out else [[]] * 13
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _VERDICT_TYPES)], names=[c.split()[0] for c in _VERDICT.split(", ")])

    return run


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_VERDICT_TYPES = [_ARROW[c.split()[1]] for c in _VERDICT.split(", ")]


def verdicts(judged: DataFrame, rules: Rules) -> DataFrame:
    """One row per packet: the drop reason (null: forwarded), whether it named the flow, and the flow's state, application and name after it."""
    types = {c.split()[0]: c for c in _VERDICT.split(", ")}
    block_schema = ", ".join(types[k] for k in _BLOCK_KEY)
    # Flows of over BLOCK packets, so at most one for BLOCK packets of all; others are one block, wherever their packets lie.
    many = judged.groupBy(*KEY).count().where(F.col("count") > BLOCK).select(*KEY, F.lit(True).alias("_long"))
    cut = judged.select(*_BLOCK_KEY, *_PACKET).join(F.broadcast(many), KEY, "left")
    long = cut.where("_long").drop("_long")
    moves = _ordered(long, _BLOCK_KEY).mapInArrow(_summaries(rules), block_schema + ", moves array<string>")
    enter = moves.repartition(*KEY).sortWithinPartitions(*_BLOCK_KEY).mapInArrow(_chain(rules), block_schema + ", entering string")
    # Entering states are rows among the packets. After a join on these columns Spark would leave the repartition out, and at run time may deal
    # the join's rows out otherwise.
    rows = cut.withColumn("block", F.when(F.col("_long"), F.col("block")).otherwise(0)).drop("_long").select(*_BLOCK_KEY, *_PACKET)
    marks = enter.select(*_BLOCK_KEY, *(F.lit(-1).cast("long").alias(f.name) if f.name == "packet_no" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema[len(_BLOCK_KEY) :]), "entering")
    both = rows.withColumn("entering", F.lit(None).cast("string")).union(marks)
    return _ordered(both, _BLOCK_KEY).mapInArrow(_walk(rules), _VERDICT)


def engine_flows(judged: DataFrame, judged_verdicts: DataFrame) -> DataFrame:
    """One row per flow: counters, last state, application, name, action, and how many packets were dropped."""
    last = judged_verdicts.groupBy(*KEY).agg(
        F.max_by(F.struct("state", "app", "name"), "packet_no").alias("last"), F.count_if(F.col("reason").isNotNull()).alias("dropped"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "FLOW")).alias("blocked_events"),
    )
    state = F.element_at(F.array(*map(F.lit, STATES)), F.col("last.state") + 1)
    return counters(judged).join(last, KEY).select(
        *KEY, *TUPLE, "packets_out", "packets_in", "bytes_out", "bytes_in", "syn_seen", "syn_ack_seen", "fin_seen", "first_packet_no", "last_packet_no",
        state.alias("state"), F.col("last.app").alias("app"), F.col("last.name").alias("sni"),
        F.when(F.col("blocked_events") > 0, "DROP").otherwise("FORWARD").alias("action"), "dropped", "blocked_events",
    )


# ---- the simpler policies ----------------------------------------------------------------------------

_DIRECTED = ["capture", *TUPLE, "protocol"]


def simple_flows(packets: DataFrame, rules: Rules, policy: str) -> DataFrame:
    """Directional flows of the `working` or `mt` policy: app, sni, packets, bytes and block_from (the first dropped packet, or null).

    Until its first name a flow is told by its ports; from then on by its name. Blocking never ends.
    """
    p = inspect(packets, policy)
    named = F.when(F.col("cand_app").isNotNull(), F.col("packet_no"))
    f = p.groupBy(*_DIRECTED).agg(
        F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"), F.min("packet_no").alias("first_packet_no"),
        F.min(named).alias("named_from"), F.min_by(F.struct("cand_app", "cand_name"), named).alias("told"),
    )
    dns = (F.col("dst_port") == 53) | (F.col("src_port") == 53)
    before = F.when(dns, "DNS").when(F.col("dst_port") == 443, "HTTPS").when(F.col("dst_port") == 80, "HTTP").otherwise("Unknown")
    # DNS by port is final: a name only comes in with the first packet then.
    told = F.when(~dns | (F.col("named_from") == F.col("first_packet_no")), F.col("told"))
    blocked = lambda app, name: (F.col("src_ip").isin(*rules.ips) if rules.ips else F.lit(False)) | (app.isin(*rules.apps) if rules.apps else F.lit(False)) | name_contains(name, rules)
    f = f.withColumns({"told": told, "before": before}).withColumn("named_from", F.when(F.col("told").isNotNull(), F.col("named_from")))
    at_once = F.coalesce(F.col("named_from") > F.col("first_packet_no"), F.lit(True)) & blocked(F.col("before"), F.lit(""))
    later = F.col("told").isNotNull() & blocked(F.col("told.cand_app"), F.col("told.cand_name"))
    return f.select(
        *_DIRECTED, F.coalesce("told.cand_app", "before").alias("app"), F.coalesce("told.cand_name", F.lit("")).alias("sni"), "packets", "bytes", "first_packet_no",
        F.when(at_once, F.col("first_packet_no")).when(later, F.col("named_from")).alias("block_from"), "named_from", "before",
    )


def simple_verdicts(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """The packets with `app` (as counted with the packet) and `dropped`."""
    f = flows.select(*_DIRECTED, "block_from", "named_from", "before", F.col("app").alias("_app"))
    p = packets.join(f, _DIRECTED)
    named = F.coalesce(F.col("packet_no") >= F.col("named_from"), F.lit(False))
    return p.withColumns({"app": F.when(named, F.col("_app")).otherwise(F.col("before")), "dropped": F.coalesce(F.col("packet_no") >= F.col("block_from"), F.lit(False))}).drop("_app", "before", "named_from", "block_from")
