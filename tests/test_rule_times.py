"""Rules in time and patterns by the thousand, against plain walks."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowloom.operators import inspect, patterns, rule_times
from flowloom.sources.rules import Rules, is_pattern

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def edits_of(seed: int, n: int) -> list[tuple]:
    rng, out = random.Random(seed), []
    values = {"IP": ["1.1.1.1", "2.2.2.2"], "PORT": ["80", "443"], "APP": ["HTTP"], "DOMAIN": ["A.com", "b.a.com"], "PATTERN": ["*.a.com", "?.com", "c[xy]*"]}
    for k in range(n):
        kind = rng.choice(list(values))
        action = rng.choice(["block", "block", "unblock", "clear"]) if rng.random() < 0.3 else rng.choice(["block", "unblock"])
        out.append((START + timedelta(hours=rng.randrange(100)), k, action, None if action == "clear" else kind, None if action == "clear" else rng.choice(values[kind])))
    return out


def rules_at(edits: list[tuple], time: datetime) -> Rules:
    rules = Rules()
    for at, _, action, kind, value in sorted(edits, key=lambda e: e[:2]):
        if at > time:
            break
        if action == "clear":
            rules = rules.clear()
            continue
        if kind == "DOMAIN":
            value = value.lower()
        name = {"IP": "ip", "PORT": "port", "APP": "app"}.get(kind, "domain")
        rules = getattr(rules, f"{action}_{name}")(int(value) if kind == "PORT" else value)
    return rules


@pytest.mark.parametrize("width", [3_600_000_000, 50_000_000_000, rule_times.WIDTH * 1000])
def test_rules_in_force_are_those_of_a_walk(spark, monkeypatch, width):
    monkeypatch.setattr(rule_times.as_of, "__defaults__", (width,))
    edits, rng = edits_of(width % 7, 120), random.Random(2)
    rows = [(k, START + timedelta(hours=rng.randrange(-3, 104), minutes=rng.choice([0, 0, 30])), rng.choice(["1.1.1.1", "2.2.2.2", "9.9.9.9"]), rng.choice([80, 443, 9]), rng.choice(["HTTP", "DNS", None]), rng.choice(["a.com", "B.a.com", "x.a.com", "cx.z", "", None])) for k in range(200)]
    rows += rows[:5] + [(999, None, "1.1.1.1", 80, "HTTP", "a.com")]
    packets = spark.createDataFrame(rows, "k int, at timestamp, src_ip_s string, dst_port int, app string, name string")
    got = rule_times.block_reason_as_of(packets, spark.createDataFrame(edits, rule_times.EDITS), F.col("at"))
    assert got.columns == [*packets.columns, "reason"]

    def reason(row):
        _, time, ip, port, app, name = row
        if time is None:
            return None
        r = rules_at(edits, time)
        low = (name or "").lower()
        known = [d.lower() for d in r.domains if not is_pattern(d)]
        octets = int.from_bytes(bytes(map(int, ip.split("."))), "little")
        hit = low and (low in known or any(inspect.matches_pattern(low, d) for d in r.domains if is_pattern(d)))
        return "IP" if octets in r.ips else "PORT" if port in r.ports else "APP" if app in r.apps else "DOMAIN" if hit else None

    assert sorted((r.k, r.reason) for r in got.collect()) == sorted(((r[0], reason(r)) for r in rows), key=lambda x: (x[0], str(x[1])))


def test_intervals_hold_what_was_in_force(spark):
    edits = edits_of(5, 150)
    spans = [(r.kind, r.value, r["from"].timestamp(), r.to.timestamp() if r.to else float("inf")) for r in rule_times.intervals(spark.createDataFrame(edits, rule_times.EDITS)).collect()]
    for hour in range(101):
        time = START + timedelta(hours=hour, minutes=1)
        r = rules_at(edits, time)
        want = {("PORT", str(p)) for p in r.ports} | {("APP", a) for a in r.apps} | {("PATTERN" if is_pattern(d) else "DOMAIN", d) for d in r.domains} | {("IP", ".".join(str(ip >> s & 255) for s in (0, 8, 16, 24))) for ip in r.ips}
        assert {(k, v) for k, v, a, b in spans if a <= time.timestamp() < b} == want
    assert rule_times.intervals(spark.createDataFrame([], rule_times.EDITS)).count() == 0


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", t, 0, t) for t in range(0, 50, 3)] + [(None, 7, 0, 1), ("z", 5, 0, 2)], "k string, time long, order long, x int")
    right = spark.createDataFrame([("a", 5, 0, "five"), ("a", 6, 1, "late"), ("a", 6, 0, "six"), ("a", 40, 0, None), (None, 2, 0, "none")], "k string, time long, order long, v string")
    want = {("a", t): None if t < 6 else "six" if t < 9 else "late" if t < 40 else None for t in range(0, 50, 3)} | {(None, 7): None, ("z", 5): None}
    for width in (1, 10, 1000):
        got = rule_times.as_of(left, right, ["k"], "time", "order", "v", width)
        assert {(r.k, r.time): r.v for r in got.collect()} == want and got.count() == left.count()


def some_patterns(seed: int, n: int) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("abcx.-") for _ in range(rng.randrange(1, 5)))
    made = ["".join(rng.choice([part(), "*", "?", "[ab]", "[!x]", "[a-c]"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return [rng.choice(["", "*."]) * (not m.startswith("*")) + m for m in made] + ["*.a.b", "x*a?c", "[]a]b"], [part() + part() + part() for _ in range(200)] + ["a.b", "q.a.b", "]b"]


def test_a_thousand_patterns_are_those_of_expressions(spark):
    globs, names = some_patterns(6, 1_000)
    known = patterns.Patterns([g.lower() for g in globs])
    for n in names:
        assert known.matches(n) == sorted({g for g in globs if inspect.matches_pattern(n, g)})
    few = [g for g in globs if not g.startswith("[]")][:60]
    rules = Rules()
    for g in few:
        rules = rules.block_domain(g if is_pattern(g) else g + "*")
    rows = spark.createDataFrame([("1.1.1.1", 5, "HTTP", n) for n in names], "src_ip_s string, dst_port int, app string, name string")
    want = {r.name for r in rows.where(inspect.domain_blocked(F.col("name"), rules)).collect()}
    assert {r.name for r in inspect.block_reason_by_join(rows, rules.table(spark)).collect() if r.reason} == want


def test_blocks_of_patterns_and_terms(spark, monkeypatch):
    globs, names = some_patterns(7, 40)
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "value string")
    named = spark.createDataFrame([(n,) for n in [*names, "", None, names[0].upper()]], "name string")
    texts = [("a", "Abab ab"), ("b", None), ("c", ""), ("d", "ababab"), ("a", "Abab ab")]
    rows = spark.createDataFrame(texts, "id string, text string")
    pairs = {tuple(r) for r in patterns.pattern_matches(named, frame([*globs, None])).collect()}
    counts = sorted(map(tuple, patterns.term_counts(rows, frame(["ab", "ABAB", "b a", "", None, "zz"])).collect()))
    assert pairs == {(n, g) for n in names if n for g in map(str.lower, globs) if inspect.matches_pattern(n, g)}
    assert counts == sorted([("a", "ab", 3), ("a", "abab", 1), ("a", "b a", 1)] * 2 + [("d", "ab", 3), ("d", "abab", 2)])
    monkeypatch.setattr(patterns, "BLOCK", 5)
    assert {tuple(r) for r in patterns.pattern_matches(named, frame([*globs, None])).collect()} == pairs
    monkeypatch.setattr(patterns, "BLOCK", 2)
    assert sorted(map(tuple, patterns.term_counts(rows, frame(["ab", "ABAB", "b a", "", None, "zz"])).collect())) == counts
    assert patterns.pattern_matches(named, frame([])).count() == 0 and patterns.term_counts(rows, frame([])).count() == 0


def test_packets_are_computed_once(spark, tmp_path, monkeypatch):
    """Where there is a folder for it, the plan's branches read what the packets ask instead of computing it again."""
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: str(tmp_path))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k, START + timedelta(hours=k), "1.1.1.1", 80, "HTTP", "a.com") for k in range(50)]
    packets = spark.createDataFrame(rows, "k int, at timestamp, src_ip_s string, dst_port int, app string, name string")
    got = rule_times.block_reason_as_of(packets.mapInArrow(counted, packets.schema), spark.createDataFrame(edits_of(3, 60), rule_times.EDITS), F.col("at"))
    assert got.count() == 50 and seen.value == 50
