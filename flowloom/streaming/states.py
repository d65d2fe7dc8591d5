"""Flow states: the engine's state machine over flows that end when they are idle, of a batch and of a stream.

A flow that has been idle for more than IDLE whole seconds is over; the next packet of its addresses starts a new one.

Batch: gaps between a flow's packets cut it into episodes, each a flow of its own for the operators of flows. Gaps are found in blocks of packets and
carried from block to block, so a flow may hold a third of all packets.

Stream: `transformWithState` keeps the flows of a shard (of their keys' hash): machine states, counters and the packets that wait. Packets of a stream come in
any order within `late`; they wait until the watermark is past them, are then taken in the order of their numbers, and an
event-time timer ends a flow that nothing came for. The rows are those of the batch, whatever the micro-batches were. The state lives in
Spark's state store (RocksDB), is checkpointed with the stream and survives lost executors.

Defined results: packets later than `late` are dropped by the watermark; flows that the watermark hasn't passed yet aren't emitted; packets
without a time take no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.network import keeps_direction
from ..operators import flows
from ..operators.flows import BLOCK, KEY, STATES, TUPLE
from ..sources.rules import Rules

#: Whole seconds of idleness that a flow outlives.
IDLE = 300
#: Groups of flows that share a state.
SHARDS = 512
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_KEY_TYPES = "capture string, lo_ip long, lo_port int, hi_ip long, hi_port int, protocol int"
COLUMNS = [*KEY, "started", "ended", "state", "app", "sni", "packets_out", "packets_in", "bytes_out", "bytes_in", "first_packet_no", "last_packet_no", "dropped", "blocked_events"]
SCHEMA = f"{_KEY_TYPES}, started timestamp, ended timestamp, state string, app string, sni string, packets_out long, packets_in long, bytes_out long, bytes_in long, first_packet_no long, last_packet_no long, dropped long, blocked_events long"
#: What the machine asks of a packet, and what the counters do.
_ASKED = ["packet_no", "tcp_flags", "cand_app", "cand_name", "cand_reason", "own_reason", "frame_len", "is_lo", "micros"]


def event_time(seconds: Column, fraction: Column, nanos: Column) -> Column:
    """A packet's time to the microsecond."""
    return F.timestamp_micros(seconds * 1_000_000 + F.when(nanos, F.floor(fraction / 1000)).otherwise(fraction))


def timed_packets(packets: DataFrame, rules: Rules, time: str = "event_ts") -> DataFrame:
    """Judged packets (see flows.judged_packets) with their times and ways."""
    judged = flows.judged_packets(packets.withColumn("event_ts", F.col(time).cast("timestamp")).where("event_ts is not null"), rules, ("event_ts",))
    return judged.withColumn("is_lo", keeps_direction(*(F.col(c) for c in TUPLE)))


# ---- batch ---------------------------------------------------------------------------------------------


def episodes(timed: DataFrame, idle: int = IDLE) -> DataFrame:
    """Adds `episode`, from 0, to packets (KEY, packet_no, event_ts): it grows with every gap of over `idle` whole seconds before a packet."""
    over = lambda now, before: F.floor(F.unix_micros(now) / 1_000_000 - F.unix_micros(before) / 1_000_000) > idle
    rows = timed.withColumn("block", F.floor(F.col("packet_no") / BLOCK).cast("long"))
    inside = Window.partitionBy(*KEY, "block").orderBy("packet_no")
    rows = rows.withColumn("_before", F.lag("event_ts").over(inside))
    rows = rows.withColumn("_cuts", F.sum(F.coalesce(over(F.col("event_ts"), F.col("_before")), F.lit(False)).cast("int")).over(inside))
    blocks = rows.groupBy(*KEY, "block").agg(F.min_by("event_ts", "packet_no").alias("_first"), F.max_by("event_ts", "packet_no").alias("_last"), F.max("_cuts").alias("_n"))
    along = Window.partitionBy(*KEY).orderBy("block")
    cut = F.coalesce(over(F.col("_first"), F.lag("_last").over(along)), F.lit(False)).cast("int")
    blocks = blocks.withColumn("_cut", cut).withColumn("_base", F.sum(F.col("_cut") + F.col("_n")).over(along) - F.col("_n"))
    joined = rows.join(blocks.select(*KEY, "block", "_base"), [*KEY, "block"])
    return joined.withColumn("episode", (F.col("_base") + F.col("_cuts")).cast("long")).drop("_before", "_cuts", "_base")


def ended_flows(timed: DataFrame, rules: Rules, idle: int = IDLE) -> DataFrame:
    """Rows of SCHEMA: all flows of a batch of timed packets, cut where they were idle, after the state machine and the rules."""
    cut = episodes(timed, idle)
    # An episode is a flow of its own: its number goes into the first part of the key and out again.
    named = cut.withColumn("capture", F.concat(F.lpad(F.col("episode").cast("string"), 12, "0"), F.lit("/"), F.col("capture")))
    made = flows.engine_flows(named, flows.verdicts(named, rules))
    times = named.groupBy(*KEY).agg(F.min_by("event_ts", "packet_no").alias("started"), F.max_by("event_ts", "packet_no").alias("ended"))
    return made.join(times, KEY).withColumn("capture", F.substring("capture", 14, 1 << 20)).select(*COLUMNS)


# ---- stream --------------------------------------------------------------------------------------------


def _plain(row: tuple) -> list:
    """A packet as JSON takes it: the values of _ASKED, then KEY."""
    number, flags, app, name, reason, own, size, is_lo, micros, capture, *numbers = row
    text = [None if v is None or v != v else v for v in (app, name, reason, own)]
    return [int(number), None if flags is None or flags != flags else int(flags), *text, int(size), bool(is_lo), int(micros), capture, *map(int, numbers)]


class FlowStates(StatefulProcessor):
    """The flows of one shard: `held` are those that run (JSON: key, machine state and counters), `waiting` the packets that the watermark hasn't passed, `woken` the timer's time.

    Spark calls Python for every group and timer, so flows are grouped in shards: the state of a shard is read and written whole, in Arrow batches.
    """

    def __init__(self, rules: Rules, idle: int):
        self.rules, self.idle = rules, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "flow string")
        self.waiting = handle.getListState("waiting", "packet string")
        self.woken = handle.getValueState("woken", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            came = [_plain(row) for row in zip(*(part[c].tolist() for c in [*_ASKED, *KEY]))]
            if came:
                self.waiting.appendList([(json.dumps(p),) for p in came])
                first = min(p[8] for p in came) if first is None else min(first, *(p[8] for p in came))
        if first is not None:
            self._wake(first // 1000 + 1, timerValues)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packets = sorted((json.loads(text) for (text,) in self.waiting.get()), key=lambda p: p[0]) if self.waiting.exists() else []
        running = {tuple(k): flow for k, flow in (json.loads(text) for (text,) in self.held.get())} if self.held.exists() else {}
        later, over = [], []
        for p in packets:
            if p[8] >= passed:
                later.append(p)
                continue
            of = tuple(p[9:])
            flow = running.get(of)
            if flow is not None and (p[8] - flow["last"]) // 1_000_000 > self.idle:
                over.append((of, flow))
                flow = None
            running[of] = self._take(flow, p[:9])
        ended = [of for of, flow in running.items() if passed > flow["last"] + (self.idle + 1) * 1_000_000]
        over += [(of, running.pop(of)) for of in ended]  # whatever waits or is still to come is later than the watermark
        for state, kept in ((self.waiting, later), (self.held, list(running.items()))):
            if kept:
                state.put([(json.dumps(x),) for x in kept])
            else:
                state.clear()
        self.woken.clear()
        due = [min(p[8] for p in later) // 1000 + 1] if later else []
        due += [min(f["last"] for f in running.values()) // 1000 + (self.idle + 1) * 1000 + 2] if running else []
        if due:
            self._wake(min(due), timerValues)
        yield pd.DataFrame([self._row(of, f) for of, f in over], columns=COLUMNS) if over else pd.DataFrame()

    def close(self) -> None:
        pass

    def _wake(self, at_ms: int, timerValues) -> None:
        """One timer for the shard: the earliest that was asked for."""
        at = max(at_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if self.woken.exists():
            known = self.woken.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.woken.update((at,))
        self.handle.registerTimer(at)

    def _take(self, flow: dict | None, p: list) -> dict:
        number, *asked, own, size, is_lo, micros = p
        if flow is None:
            flow = {"machine": flows._first(self.rules), "opened_lo": is_lo, "first": number, "start": micros, "packets": [0, 0], "bytes": [0, 0], "dropped": 0, "blocked": 0}
        flags, app, name, reason = asked
        state = tuple(tuple(v) if isinstance(v, list) else v for v in flow["machine"])
        state, dropped, _ = flows.advance(state, (flags, None if app is None else (app, name), reason, own))
        way = 0 if is_lo == flow["opened_lo"] else 1
        flow["packets"][way] += 1
        flow["bytes"][way] += size
        flow["dropped"] += dropped is not None
        flow["blocked"] += dropped is not None and dropped != "FLOW"
        return flow | {"machine": state, "last": micros, "number": number}

    @staticmethod
    def _row(key: tuple, f: dict) -> tuple:
        app, name = f["machine"][5]
        return (*key, f["start"], f["last"], STATES[f["machine"][0]], app, name, *f["packets"], *f["bytes"], f["first"], f["number"], f["dropped"], f["blocked"])


def streamed_flows(timed: DataFrame, rules: Rules, late: str = "10 seconds", idle: int = IDLE, shards: int = SHARDS) -> DataFrame:
    """Rows of SCHEMA of a stream of timed packets, as flows end. The session needs the RocksDB state store (`with_state_store`).

    shards: a task holds the running flows and waiting packets of one of them at a time; a stream that goes on keeps its number.
    """
    shard = F.pmod(F.xxhash64(*KEY), F.lit(shards)).alias("shard")
    rows = timed.withColumn("micros", F.unix_micros("event_ts")).select(shard, *KEY, *_ASKED, "event_ts").withWatermark("event_ts", late)
    schema = SCHEMA.replace("timestamp", "long")
    ended = rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=FlowStates(rules, idle), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return ended.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that streamed flows need; other settings stay."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def run_stream(spark: SparkSession, source: str, schema, rules: Rules, folder: str, files: int = 1, late: str = "10 seconds", idle: int = IDLE) -> DataFrame:
    """Streams Parquet files of timed packets, `files` in a micro-batch, to the end of what is there; the flows that ended.

    Run again with the same folder, it goes on with the files that have come since.
    """
    stream = with_state_store(spark).readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    sink = streamed_flows(stream, rules, late, idle).writeStream.format("parquet").option("path", f"{folder}/flows").option("checkpointLocation", f"{folder}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{folder}/flows")
