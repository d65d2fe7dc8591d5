"""Captures read in ranges equal captures read from end to end, whatever their payloads look like."""

import io
import random
import struct

import pytest
from test_captures import capture_bytes

from flowloom.sources import pcap, ranges


def plainly(data: bytes, longest=65_535) -> list[tuple]:
    order, _ = pcap.MAGIC[data[:4]]
    out, at, longest = [], 24, min(longest, struct.unpack(order + "I", data[16:20])[0])
    while at + 16 <= len(data):
        seconds, fraction, size, original = struct.unpack(order + "IIII", data[at : at + 16])
        if size > longest or at + 16 + size > len(data):
            break
        out.append((len(out), seconds, fraction, original, data[at + 16 : at + 16 + size]))
        at += 16 + size
    return out


def false_friends(seed: int, order="<") -> list[bytes]:
    """Payloads that hold headers, whole captures, runs of zeros and of lengths."""
    rng = random.Random(seed)
    inner = capture_bytes([bytes(rng.randrange(256) for _ in range(rng.randrange(60))) for _ in range(40)], order)
    header = struct.pack(order + "IIII", 1, 2, 30, 30)
    return [rng.choice([b"", b"x" * rng.randrange(900), inner, inner[rng.randrange(24, 60) :], header * rng.randrange(1, 30), bytes(rng.randrange(700)), struct.pack(order + "I", 16) * rng.randrange(200)]) for _ in range(300)]


@pytest.mark.parametrize("order,magic", [("<", 0xA1B2C3D4), (">", 0xA1B23C4D)])
@pytest.mark.parametrize("parts", [8, 61])
def test_ranges_equal_one_walk(spark, tmp_path, order, magic, parts):
    data = capture_bytes(false_friends(1, order), order, magic)
    (tmp_path / "big.pcap").write_bytes(data)
    (tmp_path / "short.pcap").write_bytes(capture_bytes([b"a", b"bc"]))
    (tmp_path / "none.pcap").write_bytes(capture_bytes([]))
    got = pcap.read_captures(spark, str(tmp_path), -(-len(data) // parts)).collect()
    assert sorted((r.packet_no, r.ts_sec, r.ts_frac, r.orig_len, bytes(r.data)) for r in got if r.capture == "big.pcap") == plainly(data)
    assert sorted(bytes(r.data) for r in got if r.capture == "short.pcap") == [b"a", b"bc"] and not any(r.capture == "none.pcap" for r in got)
    assert all(r.nanos == (magic == 0xA1B23C4D) for r in got if r.capture == "big.pcap")
    spark.dataSource.register(pcap.PcapSource)
    assert {tuple(r)[1:] for r in spark.read.format("pcap").load(str(tmp_path)).collect()} == {tuple(r)[1:] for r in got}


@pytest.mark.parametrize("range_bytes", [16, 40, 333, 70_000])
def test_any_size_of_ranges(spark, tmp_path, range_bytes):
    frames = [b"x" * n for n in (0, 1, 900, 0, 5, 66, 3_000, 2)] if range_bytes < 333 else false_friends(2)[:60]
    data = capture_bytes(frames)
    (tmp_path / "a.pcap").write_bytes(data)
    got = ranges.read_ranges(spark, str(tmp_path / "a.pcap"), range_bytes).collect()
    assert sorted((r.packet_no, bytes(r.data)) for r in got) == list(enumerate(frames))


@pytest.mark.parametrize("what", ["cut", "long", "over"])
def test_a_bad_record_ends_the_file_and_not_its_range(spark, tmp_path, what):
    """Records that stand after a bad one look perfect and don't count."""
    good = capture_bytes([b"y" * 50] * 100)
    at = 24 + 66 * 40
    bad = {"cut": good[:at] + good[at + 7 :], "long": good[: at + 8] + struct.pack("<I", 70_000) + good[at + 12 :], "over": good[:-1]}[what]
    (tmp_path / "a.pcap").write_bytes(bad)
    want = plainly(bad)
    assert len(want) == {"cut": 40, "long": 40, "over": 99}[what] or what == "cut"
    got = ranges.read_ranges(spark, str(tmp_path), 500).collect()
    assert sorted((r.packet_no, r.ts_sec, r.ts_frac, r.orig_len, bytes(r.data)) for r in got) == want


def test_a_large_file_that_is_no_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"no capture" * 1_000)
    with pytest.raises(Exception, match="not a capture"):
        ranges.read_ranges(spark, str(tmp_path), 500).collect()


def test_summaries_are_few_and_walks_meet(tmp_path):
    data = capture_bytes(false_friends(3))
    (tmp_path / "a.pcap").write_bytes(data)
    with open(tmp_path / "a.pcap", "rb") as file:
        window = ranges.Window(file, len(data))
        start, stop = len(data) // 3, len(data) // 2
        got = ranges.summarise(window, "<", 65_535, range(start, stop), stop)
        for entry, leave, n in random.Random(4).sample(got, min(len(got), 50)):
            at, count = entry, 0
            while 0 <= at < stop:
                size = struct.unpack("<I", data[at + 8 : at + 12])[0] if at + 12 <= len(data) else 70_000
                at, count = (at + 16 + size, count + 1) if size <= 65_535 and at + 16 + size <= len(data) else (-1, count)
            assert (leave, n) == (at, count)
    prose = capture_bytes([bytes(random.Random(5).randrange(32, 127) for _ in range(500))] * 200)
    (tmp_path / "b.pcap").write_bytes(prose)
    with open(tmp_path / "b.pcap", "rb") as file:
        window = ranges.Window(file, len(prose))
        assert len(ranges.summarise(window, "<", 65_535, range(50_000, 60_000), 60_000)) < 200  # of 10,000 places


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("stretch,few", [(64, 0), (1 << 17, 16)])
def test_walks_of_all_places_at_once_equal_walks_one_by_one(monkeypatch, order, stretch, few):
    monkeypatch.setattr(ranges, "STRETCH", stretch)
    monkeypatch.setattr(ranges, "FEW", few)
    data = capture_bytes(false_friends(3, order)[:40], order, 0xA1B2C3D4)[: -7]
    for longest in (200, 65_535):
        for start, stop in ((24, len(data)), (1_000, 9_000), (5_000, 5_040), (len(data) - 20, len(data))):
            window = lambda: ranges.Window(io.BytesIO(data), len(data))  # noqa: E731, B023
            places = range(start, min(stop, start + 6_000))
            assert ranges.summarise(window(), order, longest, places, stop) == ranges._walks(window(), order, longest, list(places), stop)


def test_a_range_of_packets_is_summarised_by_few_reads():
    """The walks from 65,551 places took a read each."""
    data = capture_bytes([bytes(k % 40) + b"abc" for k in range(4_000)])

    class Counted(ranges.Window):
        takes = 0

        def take(self, place, n):
            self.takes += 1
            return super().take(place, n)

    window = Counted(io.BytesIO(data), len(data))
    assert ranges.summarise(window, "<", 65_535, range(24, 24 + 65_551), 96 << 10)
    assert window.takes < 10_000
