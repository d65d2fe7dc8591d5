"""Captures read in ranges of bytes, so that one large file is many tasks' work.

A record's place is known only from the record before it, and payloads may look like records. No guess is made: each range is
summarised as a function of the place at which it's entered. A record is at most LONGEST bytes, so a range can be entered at the
first LONGEST + 16 places only. All of them are walked at once, by arrays over the bytes of a stretch: where the record at each
place would end, and by doubling, where the walk from each place leaves the stretch. Walks that meet go on as one, and nearly all
end at once, since their lengths aren't allowed; the few that are left go on one by one, the foremost first. The summary of a range
is one row: entered here, left there, so many records. The summaries of a file are chained from its header on, which gives each
range its true entry and the number of its first packet. Then the ranges are read, each by itself.

Defined results: those of reading a file from end to end: a record that is cut short or longer than the file's or our own limit ends the file,
whatever comes after it; files without records have no rows; a file that isn't a capture is an error.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pcap import HEADER, LONGEST, MAGIC, RAW, capture_files, open_path

#: Bytes of a range, and of the frames in a batch.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
RECORD = 16
#: Where a file's first record is.
FIRST = HEADER.size
#: Bytes that are read at once.
READ = 1 << 20
#: Bytes of a stretch that is walked from all places at once, and walks that are few enough to go on one by one.
STRETCH, FEW = 1 << 17, 16
#: Tasks for each core, at least, where there are enough ranges; and bytes of a task at most.
TASKS, TASK_BYTES = 4, 64 << 20

_SUMMARY = "path string, bytes long, range long, entries binary, leaves binary, records binary"
_ENTERED = "path string, bytes long, entry long, stop long, first_no long"


class Window:
    """The bytes of a file, read forward in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def take(self, place: int, n: int) -> bytes:
        """n bytes from `place` on (fewer at the end of the file). Places before what is held are read again."""
        if place < self.at or place + n > self.at + len(self.held):
            self.file.seek(place)
            self.at, self.held = place, self.file.read(min(max(n, READ), self.size - place))
        return self.held[place - self.at : place - self.at + n]


def file_rules(window: Window, name: str) -> tuple[str, bool, int]:
    """(byte order, whether fractions are nanoseconds, longest record) of a capture file."""
    head = window.take(0, HEADER.size)
    if len(head) < HEADER.size or head[:4] not in MAGIC:
        raise ValueError(f"{name}: not a capture file")
    order, nanos = MAGIC[head[:4]]
    return order, nanos, min(LONGEST, struct.unpack_from(order + "I", head, 16)[0])


def _stretch(window: Window, order: str, longest: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where the walk from each place of start to end leaves this stretch or where it ends in it, whether it ends, records until then)."""
    n = end - start
    raw = np.frombuffer(window.take(start, n + RECORD - 1), np.uint8)
    heads = max(0, min(n, len(raw) - RECORD + 1))  # places with a whole header
    b = [raw[8 + k : 8 + k + heads].astype(np.int64) for k in range(4)]
    if order == ">":
        b.reverse()
    size = b[0] | b[1] << 8 | b[2] << 16 | b[3] << 24
    at = np.arange(heads)
    good = (size <= longest) & (start + at + RECORD + size <= window.size)
    jump = np.arange(n + longest + RECORD)  # places after the stretch stay where they are, as those without a record do
    jump[:heads] = np.where(good, at + RECORD + size, at)
    records = np.zeros(len(jump), np.int64)
    records[:heads] = good
    while not np.array_equal(further := jump[jump], jump):
        records += records[jump]
        jump = further
    return start + jump[:n], jump[:n] < n, records[:n]


def summarise(window: Window, order: str, longest: int, entries: range | list[int], stop: int) -> list[tuple[int, int, int]]:
    """(entry, where the range is left or -1 if the file ends in it, records) of the entries that have a record."""
    entry = np.asarray(entries, np.int64)
    place, records, ended = entry.copy(), np.zeros(len(entry), np.int64), np.zeros(len(entry), bool)
    while True:
        ahead = np.unique(place[~ended & (place < stop)])
        if len(ahead) <= FEW:
            break
        start = int(ahead[0])
        end = min(stop, start + STRETCH)
        then, ends, more = _stretch(window, order, longest, start, end)
        here = np.flatnonzero(~ended & (place < end))
        at = place[here] - start
        place[here], ended[here] = then[at], ends[at]
        records[here] += more[at]
    rest = {e: (leave, n) for e, leave, n in _walks(window, order, longest, ahead.tolist(), stop)}
    leave = np.where(ended, -1, place)
    for e in ahead.tolist():
        here = ~ended & (place == e)
        leave[here], more = rest.get(e, (-1, 0))
        records[here] += more
    some = records > 0
    return list(zip(entry[some].tolist(), leave[some].tolist(), records[some].tolist()))


def _walks(window: Window, order: str, longest: int, entries: list[int], stop: int) -> list[tuple[int, int, int]]:
    """As `summarise`, place by place.

    The foremost walk goes on first, so that a walk that comes to another one's place finds it still there.
    """
    size_at = struct.Struct(order + "I")
    ahead = list(entries)
    heapq.heapify(ahead)
    walk = {place: k for k, place in enumerate(ahead)}  # place -> number of the walk that is there
    start = list(ahead)
    records, joined, leave = [0] * len(start), [None] * len(start), [-1] * len(start)
    while ahead:
        place = heapq.heappop(ahead)
        k = walk.pop(place)
        if place >= stop:
            leave[k] = place
            continue
        head = window.take(place, RECORD)
        if len(head) < RECORD:
            continue
        size = size_at.unpack_from(head, 8)[0]
        then = place + RECORD + size
        if size > longest or then > window.size:
            continue
        records[k] += 1
        other = walk.get(then)
        if other is None:
            walk[then] = k
            heapq.heappush(ahead, then)
        else:
            joined[k] = (other, records[k] - records[other])  # from here on it does what the other one does
    found = []
    for k, entry in enumerate(start):
        end, more = k, 0
        while joined[end] is not None:
            more += joined[end][1]
            end = joined[end][0]
        if records[end] + more > 0:
            found.append((entry, leave[end], records[end] + more))
    return found


def _summaries(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, number in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "range"))):
                fs, root = open_path(path)
                with fs.open_input_file(root) as file:
                    window = Window(file, size)
                    order, _, longest = file_rules(window, root.rsplit("/", 1)[-1])
                    start, stop = number * range_bytes, min(size, (number + 1) * range_bytes)
                    entries = [FIRST] if not number else range(max(start, FIRST), min(stop, start + longest + RECORD))
                    found = summarise(window, order, longest, entries, stop)
                columns = np.array([f for f in found if f[1] >= 0], np.int64).reshape(-1, 3).T  # a walk that ends needs no count: nothing comes after it
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path], pa.string()), *(pa.array([v], pa.int64()) for v in (size, number)), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                    names=[c.split()[0] for c in _SUMMARY.split(", ")],
                )

    return run


def _chain(range_bytes: int):
    """Follows each file from its header through the summaries, which come in the order of file and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, packets = None, -1, 0
        for batch in batches:
            out = []
            for path, size, number, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                if path != file:
                    file, place, packets = path, FIRST, 0
                if number != place // range_bytes:
                    continue
                entries, leaves, records = (np.frombuffer(c, np.int64) for c in columns)
                out.append((path, size, place, min(size, (number + 1) * range_bytes), packets))
                k = int(np.searchsorted(entries, place))
                # A walk that leads to no other range ends the file in this one.
                place, packets = (int(leaves[k]), packets + int(records[k])) if k < len(entries) and entries[k] == place else (-1, 0)
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if not k else pa.int64()) for k, c in enumerate(columns)], names=[c.split()[0] for c in _ENTERED.split(", ")])

    return run


_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RAW.split(", ")]
    for batch in batches:
        for path, size, place, stop, number in zip(*(c.to_pylist() for c in batch.columns)):
            fs, root = open_path(path)
            name = root.rsplit("/", 1)[-1]
            with fs.open_input_file(root) as file:
                window = Window(file, size)
                order, nanos, longest = file_rules(window, name)
                record, rows, held = struct.Struct(order + "IIII"), [], 0
                while place < stop:
                    head = window.take(place, RECORD)
                    if len(head) < RECORD:
                        break
                    seconds, fraction, length, original = record.unpack(head)
                    if length > longest or place + RECORD + length > size:
                        break
                    rows.append((name, number, seconds, fraction, nanos, length, original, window.take(place + RECORD, length)))
                    place, number, held = place + RECORD + length, number + 1, held + length + RECORD
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=names)


def _tasks(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> int:
    """Tasks for the ranges of the files: small ranges share one."""
    ranges = sum(max(1, -(-size // range_bytes)) for _, size in files)
    return min(ranges, max(TASKS * spark.sparkContext.defaultParallelism, -(-sum(size for _, size in files) // TASK_BYTES)))


def entries(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> DataFrame:
    """(path, bytes, entry, stop, first_no) of the ranges that the walk from the header comes to, of files (path, bytes)."""
    listed = spark.createDataFrame(files, "path string, bytes long")
    each = listed.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("bytes") / range_bytes) - 1))).alias("range"))
    found = each.repartition(_tasks(spark, files, range_bytes), "path", "range").mapInArrow(_summaries(range_bytes), _SUMMARY)
    ordered = found.repartition(min(len(files), 4096), "path").sortWithinPartitions("path", "range")
    return ordered.mapInArrow(_chain(range_bytes), _ENTERED)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of RAW of a file or of a folder's *.pcap files. Files of one range aren't summarised first."""
    files = capture_files(path)
    short = [f for f in files if f[1] <= range_bytes]
    long = [f for f in files if f[1] > range_bytes]
    plans = []
    if short:
        plans.append(spark.createDataFrame([(p, size, FIRST, size, 0) for p, size in short], _ENTERED).repartition(len(short), "path"))
    if long:
        plans.append(entries(spark, long, range_bytes).repartition(_tasks(spark, long, range_bytes), "path", "entry"))
    if not plans:
        return spark.createDataFrame([], RAW)
    read = [p.mapInArrow(_packets, RAW) for p in plans]
    return read[0] if len(read) == 1 else read[0].union(read[1])
