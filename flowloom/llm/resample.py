"""Importance resampling towards a target corpus: hashed n-gram counts, weights, and a distributed quickselect.

Features are the runs of one and two words of a text, counted with repeats in BUCKETS buckets by the CRC-32 of their bytes. A
bucket's gain says how much more frequent it is in the target than in the source, and a document's weight is the mean gain of its
features. A random score that depends on the weight, the id and the seed turns "draw without replacement by weight" into "take
the highest scores".

How many are taken follows from how many rows may be drawn, so the score of the last one has to be found exactly. Rows get a
composite key without ties (score, id, figures, place). Random rows are pivots; one aggregate counts the keys before, at and
after each of them; the keys between two neighbouring pivots go on to the next round until the k-th key is itself a pivot.
Each round leaves about 1 / PIVOTS of the keys. Only the drawn rows are sorted, in ranges, and numbered.

The CRC of a pair of words follows from those of its words: appending bytes is linear over bits, so tables of how a number of
bytes moves a CRC replace hashing each pair.

Defined results: a null text has no words and weight 0; rows without an id draw with an empty number and come after equal scores with one;
repeated rows are rows of their own; without a source or target text all gains follow from the counts of 0; an
empty table gives none; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, materialise, shared_dir, steps, words

BUCKETS = 10_000
#: Words that a document has at least to be drawn, and percent of those documents that are.
LEAST_WORDS, PERCENT = 20, 25
#: Pivots of a round of the quickselect.
PIVOTS = 32
#: Words of up to so many bytes have a table row of how they move a CRC.
TABLE_WORD = 32
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), c >> np.uint32(1) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c.astype(np.uint32)


_BYTE = _byte_table()


def _moves() -> np.ndarray:
    """[n, k, v]: what n zero bytes make of a register that holds v in its byte k and zeros elsewhere."""
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [at]
    for _ in range(TABLE_WORD):
        at = _BYTE[at & np.uint32(255)] ^ (at >> np.uint32(8))
        out.append(at)
    return np.stack(out)


_MOVES = _moves()


class WordCodes(dict):
    """word -> its CRC-32 in the low 32 bits, its length above them; forgets all when it holds CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word) | len(word) << 32
        return value


def feature_crcs(texts: list[list[bytes]], cache: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32 of each feature, the text that each belongs to): all words, then all pairs of neighbouring words."""
    flat = list(chain.from_iterable(texts))
    code = np.fromiter((cache[w] for w in flat), np.int64, len(flat))
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    crc, size = (code & 0xFFFFFFFF).astype(np.uint32), code >> 32
    left = np.flatnonzero(row[1:] == row[:-1])
    register = ~crc[left]
    spaced = ~(_BYTE[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8)))
    n = np.minimum(size[left + 1], TABLE_WORD)
    pair = crc[left + 1].copy()
    for k in range(4):
        pair ^= _MOVES[n, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for k in np.flatnonzero(size[left + 1] > TABLE_WORD).tolist():
        pair[k] = zlib.crc32(flat[left[k] + 1], int(spaced[k]))
    return np.concatenate([crc, pair]), np.concatenate([row, row[left]])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each of the BUCKETS buckets: one row a bucket leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = WordCodes(), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in steps(whole, "text"):
                crcs, _ = feature_crcs([words(t) for t in batch.column("text").to_pylist()], cache)
                total += np.bincount(crcs % np.uint32(BUCKETS), minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    found = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)  # BUCKETS rows at most come to the driver
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of (smoothed share of the target) / (smoothed share of the source) of each bucket, floored."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for whole in batches:
            for batch in steps(whole, "text"):
                texts = [words(t) for t in batch.column("text").to_pylist()]
                crcs, row = feature_crcs(texts, cache)
                count = np.bincount(row, minlength=len(texts))
                total = np.bincount(row, gain[crcs % np.uint32(BUCKETS)], len(texts)).astype(np.int64)  # whole numbers below 2^53
                arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.fromiter(map(len, texts), np.int64, len(texts)), count, total // np.maximum(count, 1)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def score(weight: Column, doc_id: Column, seed: int) -> Column:
    """weight plus a Gumbel variate, in thousandths, that the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _keyed(scored: DataFrame) -> DataFrame:
    """Adds `key`, whose bytes order the rows: highest score, least id (those without one last), and then whatever tells rows apart."""
    up = lambda c: F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    none = F.when(F.col("doc_id").isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    score, doc_id = -F.col("score"), F.coalesce("doc_id", F.lit(0).cast("long"))
    return scored.withColumn("key", F.concat(up(score), none, *[up(c) for c in (doc_id, F.col("n_features"), F.col("weight"), F.col("place"))]))


def kth_key(rows: DataFrame, k: int, path: str) -> bytes | None:
    """The k-th least `key` (from 1; no two rows have the same), or None if there are fewer rows.

    A round counts the keys between its sorted pivots and at each of them, so every pivot parts the rows in three exactly.
    """
    live, number, key = rows.select("key"), 0, F.col("key")
    while k >= 1:
        pivots = sorted(bytes(r.key) for r in live.orderBy(F.xxhash64("key", F.lit(number))).limit(PIVOTS).collect())
        if not pivots:
            return None
        before = sum(((key > F.lit(p)).cast("int") for p in pivots), F.lit(0))
        at = key.isin(*pivots)
        counts = {(r.before, r.at): r["count"] for r in live.groupBy(before.alias("before"), at.alias("at")).count().collect()}
        low = None
        for j in range(len(pivots) + 1):
            between, equal = counts.get((j, False), 0), counts.get((j, True), 0)
            if k <= between:
                break
            k -= between
            if k <= equal:
                return pivots[j]
            k, low = k - equal, j
        else:
            return None
        inside = live
        if low is not None:
            inside = inside.where(key > F.lit(pivots[low]))
        if j < len(pivots):
            inside = inside.where(key < F.lit(pivots[j]))
        live, number = materialise(inside, f"{path}/live{number}"), number + 1
    return None


def ranked(rows: DataFrame, path: str) -> DataFrame:
    """The rows with `rank` from 1 in the order of `key`: sorted in ranges, numbered within each, and moved by the sizes of those before."""
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    held = materialise(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), f"{path}/ordered")
    sizes = held.groupBy("part").agg(F.count("*").alias("size")).orderBy("part").collect()  # one row a partition
    first, total = [], 0
    for r in sizes:
        first.append((r.part, total))
        total += r["size"]
    offset = rows.sparkSession.createDataFrame(first, "part int, first long")
    return held.join(F.broadcast(offset), "part").withColumn("rank", F.col("first") + F.col("at") + 1).drop("part", "at", "first")


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = PERCENT, least_words: int = LEAST_WORDS, work: str | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of each row of docs (doc_id, text), drawn towards the texts of `target`."""
    path = work or shared_dir(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    found = weights(docs, gain).withColumns({"score": score(F.col("weight"), F.col("doc_id"), seed), "place": F.monotonically_increasing_id()})
    scored = _keyed(materialise(found, f"{path}/scored"))
    able = scored.where(F.col("n_words") >= least_words)
    last = kth_key(able, able.count() * percent // 100, path)
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.withColumn("rank", F.lit(None).cast("long"))
    if last is None:
        return rest.select(*out)
    drawn = (F.col("n_words") >= least_words) & (F.col("key") <= F.lit(last))
    return ranked(scored.where(drawn), path).select(*out).union(rest.where(~drawn).select(*out))
