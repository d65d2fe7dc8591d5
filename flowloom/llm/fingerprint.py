"""Homomorphic multiset hashes: a document's fingerprint is a sum of vectors, one for each of its paragraphs.

A paragraph (a line) becomes a vector of two parts. LANES lanes are cut from a cryptographic hash of its bytes and add up modulo
2^32: they tell whether two documents hold the same paragraphs as often, in whatever order. SKETCH lanes hold its shingles of
three words (all of it, if there are fewer), each as +1 or -1 in one lane, and add up modulo 2^16: the cosine of two such parts estimates how much the documents
share. Sums can be taken back, so putting in, dropping or changing a paragraph moves a fingerprint by that paragraph's vector
alone; nothing else is hashed again.

Neighbours in the order of ids are found without sorting the table in one place: bounds from a sample of the ids split it into
ranges, each range is sorted by itself, and the first row of the next range is handed to each.

Defined results: a null text is an empty one, which has no paragraph; a text of line breaks alone has empty paragraphs; rows without an id come last; rows that
share an id follow each other by a hash of their texts, then by the texts; the only row is its own next one; an empty table gives none; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hash_words, materialise, mix64, shared_dir, steps, words

#: Lanes of the hash (modulo 2^32) and of the sketch (modulo 2^16).
LANES, SKETCH = 32, 256
SHINGLE = 3
#: Bytes of text of a range; ranges at most; ids sampled for each.
RANGE_BYTES, RANGES, SAMPLED = 8 << 20, 20_000, 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Vectors:
    """Fingerprints of many lists of paragraphs at once, as (sums of hashes, sums of sketches)."""

    def __init__(self):
        self.cache = WordHashes()

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        lanes, sketch = np.zeros((len(texts), LANES), np.uint32), np.zeros((len(texts), SKETCH), np.uint16)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        if not len(owner):
            return lanes, sketch
        flat = [p for t in texts for p in t]
        vectors = np.frombuffer(b"".join([hashlib.shake_128(p).digest(4 * LANES) for p in flat]), "<u4").reshape(-1, LANES)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lanes[owner[first]] = np.add.reduceat(vectors, first, axis=0, dtype=np.uint32)
        found = [words(p.decode("utf-8", "replace")) for p in flat]
        size = np.fromiter(map(len, found), np.int64, len(found))
        hashes = hash_words([w for f in found for w in f], self.cache)
        x, of = self._shingles(hashes, size, owner)
        lane = (x % np.uint64(SKETCH)).astype(np.int64)
        sign = np.where(x >> np.uint64(63), 1.0, -1.0)
        sums = np.bincount(of * SKETCH + lane, sign, len(texts) * SKETCH).astype(np.int64)
        return lanes, (sums.reshape(-1, SKETCH) & 0xFFFF).astype(np.uint16)

    @staticmethod
    def _shingles(hashes: np.ndarray, size: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each shingle, the text it belongs to): SHINGLE words of one paragraph, or all words of a shorter one."""
        paragraph = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
        take = np.minimum(SHINGLE, size)[paragraph]
        start = np.flatnonzero(at <= size[paragraph] - take)
        with np.errstate(over="ignore"):
            x = take[start].astype(np.uint64)
            for k in range(SHINGLE):
                here = k < take[start]
                x = np.where(here, x * _PRIME + hashes[np.minimum(start + k, len(hashes) - 1)], x)
        return mix64(x), owner[paragraph[start]]


def paragraphs(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split(b"\n") if text else []


def add(a: tuple, b: tuple) -> tuple:
    """Fingerprints of the paragraphs of both."""
    return a[0] + b[0], a[1] + b[1]


def remove(a: tuple, b: tuple) -> tuple:
    """Fingerprints of a's paragraphs without b's."""
    return a[0] - b[0], a[1] - b[1]


def as_text(prints: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Each fingerprint in hexadecimal digits: the lanes, then the sketch."""
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(prints[0].astype(">u4"), prints[1].astype(">u2"))]


def from_text(value: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(value)
    return np.frombuffer(raw[: 4 * LANES], ">u4").astype(np.uint32), np.frombuffer(raw[4 * LANES :], ">u2").astype(np.uint16)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row: 1 if the fingerprints are equal, else the cosine of the sketches, within 0 to 1 (0 if either is empty)."""
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].astype(np.int16).astype(np.float64), b[1].astype(np.int16).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for whole in batches:
            for batch in steps(whole, "text"):
                found = as_text(vectors.of([paragraphs(t) for t in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return _plain(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# ---- neighbours in the order of ids -------------------------------------------------------------------

_PAIRED = "doc_id long, text string, next_text string"


def _order(doc_id: Column, text: Column) -> Column:
    """A key whose bytes order rows: largest id first, rows without one last, then a hash of the text."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    down = F.lit(2**63 - 1).bitwiseXOR(doc_id)  # the largest id is the least unsigned number
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number(F.coalesce(down, F.lit(0).cast("long"))), number(F.xxhash64(text)))


def with_next(docs: DataFrame, work: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls `run` with batches of (doc_id, text, next_text): the rows from the largest id down, each with the text of the row after it.

    Keys alone are read first. Whole texts are shuffled once; ranges are sorted by Spark and streamed, so a range may be of any size.
    """
    rows = _plain(docs)
    keys = materialise(rows.select(_order(F.col("doc_id"), F.col("text")).alias("key"), F.octet_length("text").alias("bytes")), f"{work}/keys")
    count, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not count:
        return docs.sparkSession.createDataFrame([], schema)
    ranges = int(min(RANGES, count, max(1, size // RANGE_BYTES + 1)))
    drawn = sorted(bytes(r.key) for r in keys.orderBy(F.xxhash64("key", F.lit(3))).limit(SAMPLED * ranges).select("key").collect())
    bounds = sorted(set(drawn[k * len(drawn) // ranges] for k in range(1, ranges)))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, bytes(k))).astype("int32")

    # The first key of each range, at most RANGES of them: what is next to the last row of the range before it (after the last range: the first).
    firsts = [(r.range, bytes(r.key)) for r in keys.groupBy(range_of("key").alias("range")).agg(F.min("key").alias("key")).orderBy("range").collect()]
    takers: dict[bytes, int] = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}
    edge = docs.sparkSession.createDataFrame([(bytearray(k), r) for k, r in takers.items()], "key binary, range int")
    keyed = rows.withColumn("key", _order(F.col("doc_id"), F.col("text")))
    heads = keyed.join(F.broadcast(edge), "key").groupBy("range").agg(F.min(F.struct("key", "text")).alias("head")).select("range", F.lit(True).alias("guest"), "head.key", F.lit(None).cast("long").alias("doc_id"), "head.text")
    both = keyed.select(range_of("key").alias("range"), F.lit(False).alias("guest"), "key", "doc_id", "text").union(heads)
    placed = both.repartition("range").sortWithinPartitions("range", "guest", "key", "text").drop("key")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row that waits for the one after it
        for whole in batches:
            for batch in steps(whole, "text"):
                out = []
                for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
                    if held is not None:
                        out.append((*held, text))
                    held = None if guest else (doc_id, text)
                cols = list(zip(*out)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["doc_id", "text", "next_text"])

    return placed.mapInArrow(lambda batches: run(paired(batches)), schema)


# ---- edits ---------------------------------------------------------------------------------------------

_EDITED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def spliced(docs: DataFrame, work: str | None = None) -> DataFrame:
    """Each row with its edited text, in which the next row's beginning takes the place of its second half.

    doc_id, n_chars (code points), edited, fingerprint, edited_fingerprint, near_edited and near_next (likeness of the fingerprint to the edited text's and to the next row's).
    The edited text's fingerprint is the text's own without the paragraphs that the edit touches, and with those it puts in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            after = [t or "" for t in batch.column("next_text").to_pylist()]
            edited, dropped, put = [], [], []
            for text, other in zip(texts, after):
                half = len(text) // 2
                head, tail = text[: len(text) - half], other[:half]
                edited.append(head + tail)
                kept = head.rfind("\n") + 1  # paragraphs before this one stay as they are
                dropped.append(paragraphs(text[kept:]) or [b""] * bool(text))
                put.append(paragraphs(edited[-1][kept:]) or [b""] * bool(edited[-1]))
            # Rows follow each other, so the next row's fingerprint is that of the row after it; only the last one's is asked for.
            whole = [paragraphs(t) for t in [*texts, after[-1]]]
            prints = vectors.of(whole)
            own, following = (prints[0][:-1], prints[1][:-1]), (prints[0][1:].copy(), prints[1][1:].copy())
            apart = [k for k in range(len(texts) - 1) if after[k] is not texts[k + 1] and after[k] != texts[k + 1]]
            if apart:  # the last rows of ranges
                there = vectors.of([paragraphs(after[k]) for k in apart])
                following[0][apart], following[1][apart] = there
            changed = add(remove(own, vectors.of(dropped)), vectors.of(put))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(edited, pa.string()), pa.array(as_text(own), pa.string()),
                    pa.array(as_text(changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, following)),
                ],
                names=[c.split()[0] for c in _EDITED.split(", ")],
            )

    return with_next(docs, work or shared_dir(docs.sparkSession), run, _EDITED)
