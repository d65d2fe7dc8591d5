"""Capture files (classic pcap) as a Spark data source named `pcap`.

The source itself reads one file per partition, record by record; `read_captures` reads large files in ranges (see ranges).
A record that is cut short or longer than allowed ends its file's scan.
Writing gives one file for each capture and task, in the order of the rows; sort by packet number first.

The path may be a file, a folder or a URI that pyarrow's file systems know.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RAW = "capture string, packet_no bigint, ts_sec bigint, ts_frac bigint, nanos boolean, incl_len bigint, orig_len bigint, data binary"
#: Longest record, whatever the file allows.
LONGEST = 65_535
# The file's first four bytes -> byte order, whether fractions are nanoseconds.
MAGIC = {
    bytes.fromhex("d4c3b2a1"): ("<", False), bytes.fromhex("a1b2c3d4"): (">", False),
    bytes.fromhex("4d3cb2a1"): ("<", True), bytes.fromhex("a1b23c4d"): (">", True),
}
HEADER = struct.Struct("<IHHiIII")


def open_path(path: str):
    """(file system, path in it) of a local path or a URI."""
    uri = path if "://" in path else f"file://{path}" if path.startswith("/") else path
    return pa.fs.FileSystem.from_uri(uri)


def capture_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of all *.pcap files below the folder."""
    fs, root = open_path(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = fs.get_file_info(root)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pa.fs.FileType.File:
        return [(path, info.size)]
    inside = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
    return [(scheme + f.path, f.size) for f in sorted(inside, key=lambda f: f.path) if f.type == pa.fs.FileType.File and f.path.endswith(".pcap")]


@dataclass
class FilePartition(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(path) for path, _ in capture_files(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        fs, root = open_path(partition.path)
        name = root.rsplit("/", 1)[-1]
        with fs.open_input_stream(root, buffer_size=1 << 20) as file:
            head = file.read(HEADER.size)
            if len(head) < HEADER.size or head[:4] not in MAGIC:
                raise ValueError(f"{name}: not a capture file")
            order, nanos = MAGIC[head[:4]]
            longest = min(LONGEST, struct.unpack_from(order + "I", head, 16)[0])
            record, number = struct.Struct(order + "IIII"), 0
            while len(at := file.read(16)) == 16:
                seconds, fraction, size, original = record.unpack(at)
                if size > longest or len(data := file.read(size)) < size:
                    return
                yield name, number, seconds, fraction, nanos, size, original, data
                number += 1


#: Packets of a capture that are never parted.
FILE_PACKETS = 1_000_000


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Drafts get their names at the commit, so a task that runs twice leaves one file."""

    def __init__(self, path: str, keep_length: bool):
        self.path, self.keep_length = path, keep_length

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        fs, root = open_path(self.path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        files: dict[str, tuple] = {}
        try:
            for row in rows:
                if row.capture not in files:
                    stem = row.capture.removesuffix(".pcap")
                    draft = f"{root}/{stem}-{task.partitionId():05d}.{task.taskAttemptId()}.draft"
                    file = fs.open_output_stream(draft)
                    file.write(HEADER.pack(0xA1B23C4D if row.nanos else 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, 1))
                    files[row.capture] = (file, draft, f"{root}/{stem}-{task.partitionId():05d}.pcap")
                data = bytes(row.data)
                files[row.capture][0].write(struct.pack("<IIII", row.ts_sec, row.ts_frac, len(data), row.orig_len if self.keep_length else len(data)) + data)
        finally:
            for file, *_ in files.values():
                file.close()
        return _Written([(draft, name) for _, draft, name in files.values()])

    def commit(self, messages: list[_Written | None]) -> None:
        fs, _ = open_path(self.path)
        for message in messages:
            for draft, name in message.files if message else []:
                fs.move(draft, name)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = open_path(self.path)
        for message in messages:
            for draft, _ in message.files if message else []:
                fs.delete_file(draft)


class PcapSource(DataSource):
    """Options: path; keep_orig_len (default false: the written original length is the captured one)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], str(self.options.get("keep_orig_len", "false")).lower() == "true")


def read_captures(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Rows of RAW; capture is the file's name and packet_no counts its records from 0. Files of over range_bytes (64 MB) are many tasks' work."""
    from .ranges import RANGE_BYTES, read_ranges

    return read_ranges(spark, path, range_bytes or RANGE_BYTES)


def write_captures(packets: DataFrame, path: str, keep_orig_len: bool = False) -> None:
    """Writes rows of RAW in packet order; a capture of over FILE_PACKETS packets is several tasks' work and may be several numbered files."""
    packets.sparkSession.dataSource.register(PcapSource)
    block = F.floor(F.col("packet_no") / FILE_PACKETS).alias("_block")
    ordered = packets.select("*", block).repartitionByRange("capture", "_block").sortWithinPartitions("capture", "packet_no")
    ordered.select(*[c.split()[0] for c in RAW.split(", ")]).write.format("pcap").option("keep_orig_len", keep_orig_len).mode("append").save(path)
