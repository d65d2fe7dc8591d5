"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised by its own k-means codebook;
a vector is filed under its pair of centroids. A query walks the pairs in the order of
their summed distance, with a heap over the two sorted lists, until it has met enough
entries; the entries of all pairs up to that distance are reranked by the exact cosine in double precision.

The codebooks are fitted on a bounded sample (SAMPLE_ROWS, or SAMPLE_CELLS for each centroid), every row is indexed. A half has about
sqrt(n) / 2 centroids, CELLS at most, so the table of pairs is bounded. How many entries are enough is measured: the true neighbours
of PROBES random rows, found by one scan of all entries, tell after how many met entries RECALL of them are reached, with
two standard errors on top.

Entries lie in buckets of about BLOCK (small first centroids share one, large ones have several by a hash); a query is sent once to each
bucket with a pair that it visits, and a task holds one bucket and streams the queries past it. Only each bucket's best few go on.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components take no part,
neither do rows without an id; vectors of any finite magnitude count (they are scaled by powers of two first, which is exact);
equal rows are one; of an id with several vectors each is an entry, and the least is the query, for which the others are candidates;
equal scores go to the smaller id; with fewer candidates than asked for all are returned; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Centroids of a half at least and at most.
LEAST_CELLS, CELLS = 16, 1024
SAMPLE_ROWS, SAMPLE_CELLS = 6_000, 20
PROBES = 256
RECALL = 0.97
BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from spread-out rows; with fewer rows than k all rows are centroids."""
    centers = np.unique(x, axis=0)
    if len(centers) <= k:
        return centers
    centers = centers[np.random.default_rng(0).choice(len(centers), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centers)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, at, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1), 0)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _distances(x, centers).argmin(1)


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows divided by powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class MultiIndex:
    """Two codebooks, and the walk over their pairs."""

    def __init__(self, x: np.ndarray, cells: int):
        self.dim, half = x.shape[1], x.shape[1] // 2
        self.books = [_kmeans(x[:, :half], cells), _kmeans(x[:, half:], cells)]
        self.counts = np.zeros([len(b) for b in self.books], np.int64)
        self.enough = 0

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        """Each row's distances to the centroids of both halves."""
        half = self.dim // 2
        return [_distances(p, c) for p, c in zip((x[:, :half], x[:, half:]), self.books)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.halves(x)
        return first.argmin(1), second.argmin(1)

    def walk(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(summed distance, pair) of all centroid pairs, nearest first."""
        a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        x, y = first[a].tolist(), second[b].tolist()
        heap = [(x[0] + y[0], 0, 0)]
        while heap:
            far, i, j = heapq.heappop(heap)
            yield far, a[i], b[j]
            # (i, j) is reached from (i, j - 1) only, and (i, 0) from (i - 1, 0): each pair comes into the heap once.
            if j + 1 < len(b):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))

    def reach(self, first: np.ndarray, second: np.ndarray) -> float:
        """How far a query looks: the distance of the pair with which it has met enough entries."""
        met, counts = 0, self.counts
        for far, i, j in self.walk(first, second):
            met += counts[i, j]
            if met >= self.enough:
                return far
        return np.inf


def _valid(vectors: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)).distinct()


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


class Entries:
    """Entries side by side, and the best of them for some queries."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        self.ids, self.given, self.raw = ids, raw, scaled(raw)
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.unit = self.raw / self.norm[:, None]

    def best(self, ids: np.ndarray, raw: np.ndarray, k: int, visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, score) of the k best visited entries of each query but its own row."""
        given, raw = raw, scaled(raw)
        norm = np.sqrt((raw * raw).sum(axis=1))
        near = (raw / norm[:, None]) @ self.unit.T
        if visited is not None:
            near[~visited] = -np.inf
        for q, e in zip(*np.nonzero(ids[:, None] == self.ids)):
            if (given[q] == self.given[e]).all():  # multiples of a vector under its id are other rows
                near[q, e] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1)
        # All entries level with the k-th (up to rounding) are scored anew, so that ties are settled by id.
        query, entry = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
        score = (self.raw[entry] * raw[query]).sum(axis=1) / (self.norm[entry] * norm[query])
        order = np.lexsort((self.ids[entry], -score, query))
        query, entry, score = query[order], entry[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < k], entry[rank < k], score[rank < k]


def _file(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.cells(unit(_matrix(batch.column("x"))))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["vec_id", "x", "i", "j"])

    return run


def _probe(ids: np.ndarray, raw: np.ndarray, k: int):
    """The k best entries of each batch for the probes, with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, e, score = Entries(batch.column("vec_id").to_numpy(), _matrix(batch.column("x"))).best(ids, raw, k)
                at = pa.array(e)
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("vec_id").take(at), batch.column("i").take(at), batch.column("j").take(at), pa.array(score)], names=["probe", "vec_id", "i", "j", "score"])

    return run


def _enough(index: MultiIndex, filed: DataFrame, probes: list, k: int, recall: float) -> int:
    """After how many met entries `recall` of the probes' true neighbours are reached."""
    ids, raw = np.array([r.vec_id for r in probes]), np.array([r.x for r in probes], float)
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    best = filed.mapInArrow(_probe(ids, raw, k), "probe long, vec_id long, i int, j int, score double").withColumn("rank", F.row_number().over(order))
    true: dict[int, set] = {}
    for r in best.where(F.col("rank") <= k).collect():  # PROBES * k rows at most
        true.setdefault(r.probe, set()).add((r.i, r.j))
    d1, d2 = index.halves(unit(raw))
    needed = []
    for q, cells in true.items():
        met, left = 0, set(cells)
        for _, i, j in index.walk(d1[q], d2[q]):
            met += int(index.counts[i, j])
            if (i, j) in left:
                left.remove((i, j))
                needed.append(met)
                if not left:
                    break
    if not needed:
        return 1
    return int(np.quantile(needed, min(1.0, recall + 2 * np.sqrt(recall * (1 - recall) / len(needed)))))


def _buckets(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, how many buckets) of each first centroid."""
    first, parts, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            at, held = at + 1, 0
        first[i], parts[i] = at, max(1, -(-n // BLOCK))
        at, held = (at + parts[i], 0) if n > BLOCK else (at, held + n)
    return first, parts


_SENT = "bucket long, entry boolean, vec_id long, x array<double>, i int, j int, reach double"


def _send(index: MultiIndex, first: np.ndarray, parts: np.ndarray):
    """Each query once for every bucket with a pair that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d1, d2 = index.halves(unit(_matrix(batch.column("x"))))
            reach = np.array([index.reach(a, b) for a, b in zip(d1, d2)])
            query, i = np.nonzero(d1 + d2.min(1)[:, None] <= reach[:, None])
            query, i = np.repeat(query, parts[i]), np.repeat(i, parts[i])
            nth = np.arange(len(i)) - np.searchsorted(query * len(first) + i, query * len(first) + i)
            sent = np.unique(np.stack([query, first[i] + nth], 1), axis=0)
            at = pa.array(sent[:, 0])
            none = pa.nulls(len(at), pa.int32())
            columns = [pa.array(sent[:, 1]), pa.array(np.zeros(len(at), bool)), batch.column("vec_id").take(at), batch.column("x").take(at), none, none, pa.array(reach[sent[:, 0]])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SENT.split(", ")])

    return run


def _rerank(index: MultiIndex, k: int):
    """Walks buckets: their entries come first and are held, then the queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, entries, cells = None, [], None, None
        for batch in batches:
            where = batch.column("bucket").to_numpy()
            kind = batch.column("entry").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])))[: batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                if where[a] != bucket:
                    bucket, held, entries = where[a], [], None
                if kind[a]:
                    held.append(part)
                    continue
                if entries is None and held:
                    entries = Entries(np.concatenate([p.column("vec_id").to_numpy() for p in held]), np.concatenate([_matrix(p.column("x")) for p in held]))
                    cells = [np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("i", "j")]
                for c in range(0, part.num_rows if entries else 0, 256):
                    some = part.slice(c, 256)
                    raw, ids = _matrix(some.column("x")), some.column("vec_id").to_numpy()
                    d1, d2 = index.halves(unit(raw))
                    visited = d1[:, cells[0]] + d2[:, cells[1]] <= some.column("reach").to_numpy()[:, None] + 1e-12
                    q, e, score = entries.best(ids, raw, k, visited)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(entries.ids[e]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: str, k: int, recall: float = RECALL, work: str | None = None) -> DataFrame:
    """The k nearest other rows of every row for which the SQL expression `is_query` over vec_id holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    path = work or shared_dir(spark)
    rows = materialise(_valid(vectors), f"{path}/vectors")
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = sizes["count"]
    rows = rows.where(F.size("x") == sizes["n"])
    cells = int(np.clip(np.sqrt(total) / 2, LEAST_CELLS, CELLS))
    by_hash = lambda seed, n: F.pmod(F.xxhash64("vec_id", "x", F.lit(seed)), F.lit(1_000_003)) <= int(min(1.0, n / total) * 1_000_003)
    # Bounded samples for the driver: rows to fit on, and probes.
    fitted = rows.where(by_hash(0, max(SAMPLE_ROWS, SAMPLE_CELLS * cells))).orderBy("vec_id", "x").collect()
    index = MultiIndex(unit(np.array([r.x for r in fitted], float)), cells) if fitted else None
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filed = materialise(rows.mapInArrow(_file(index), "vec_id long, x array<double>, i int, j int"), f"{path}/filed")
    for r in filed.groupBy("i", "j").count().collect():  # CELLS squared rows at most
        index.counts[r.i, r.j] = r["count"]
    probes = filed.where(by_hash(1, PROBES)).select("vec_id", "x").orderBy("vec_id", "x").limit(4 * PROBES).collect()
    index.enough = _enough(index, filed, probes, k, recall) if probes else total
    first, parts = _buckets(index.counts.sum(1))
    lookup = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("i") + 1)
    salt = F.pmod(F.xxhash64("vec_id", "x", F.lit(2)), lookup(parts))
    entries = filed.select((lookup(first) + salt).alias("bucket"), F.lit(True).alias("entry"), "vec_id", "x", "i", "j", F.lit(None).cast("double").alias("reach"))
    asked = filed.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    both = entries.union(asked.mapInArrow(_send(index, first, parts), _SENT))
    found = both.repartition("bucket").sortWithinPartitions("bucket", F.desc("entry")).mapInArrow(_rerank(index, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
