"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; keeps a task's arrays small whatever the batch size.
STEP_BYTES = 2 << 20
#: Distinct words that a task remembers before it starts anew.
CACHE_WORDS = 400_000

# Lower-cases A-Z; everything in ASCII but digits and letters becomes a blank; other bytes stay.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and driver and executors are one machine (as in tests) a folder of our own is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="flowloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/flowloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that this process has freed to the system: Python workers are kept for later tasks, and what they hold counts for the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A task's function over batches that gives its memory back at the end."""

    @functools.wraps(run)
    def until_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return until_end


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it holds CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(items: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter((cache[w] for w in items), np.uint64, len(items))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(batch: pa.RecordBatch, text: str, budget: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `budget` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)) + 16
    group = (np.cumsum(size) - size) // budget
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo `mod`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    ends = np.cumsum(length)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]


class Sequences:
    """Id sequences by number, in three growing arrays. Number 0 is the empty one."""

    def __init__(self):
        self.ids, self.start, self.length = np.empty(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used, self.count = 0, 1

    def add(self, ids: np.ndarray, length: np.ndarray) -> range:
        """Files sequences that stand in a row; their numbers."""
        total, first, last = self.used + len(ids), self.count, self.count + len(length)
        for name, need in (("ids", total), ("start", last), ("length", last)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(need + need // 2 - len(held), held.dtype)]))
        self.ids[self.used : total] = ids
        self.start[first:last] = self.used + np.cumsum(length) - length
        self.length[first:last] = length
        self.used, self.count = total, last
        return range(first, last)

    def add_lists(self, found: list[list[int]]) -> range:
        length = np.fromiter(map(len, found), np.int64, len(found))
        return self.add(np.fromiter(chain.from_iterable(found), np.uint32, length.sum()), length)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the numbered sequences in a row, how many each has)."""
        return gather(self.ids, self.start[numbers], self.length[numbers]), self.length[numbers]
