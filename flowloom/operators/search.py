"""Exact vector search and retrieval: best chunks of several queries, merged, ranked and capped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding import norm

#: Entries of the index that one task holds at a time, and queries that it compares with them at once.
BUCKET, QUERIES = 4096, 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def search(queries: DataFrame, index: DataFrame, top_k: int, least: float | None = None) -> DataFrame:
    """The top_k entries of each query: label, chunk_id, similarity, rank (from 0); ties go to the lesser chunk_id.

    queries: (label, vector), index: (chunk_id, vector). The index lies in buckets by a hash; the queries, a stated set, are sent to every bucket,
    whose task holds its entries and streams the queries past them, so that only each bucket's best are shuffled. Nothing passes through the driver.
    Scores below `least` don't count; scores are clamped to [-1, 1] afterwards. A query vector that is zero or not finite is an error;
    entries with null or non-finite components take no part, and a zero entry has similarity 0.
    """
    if top_k < 0:
        raise ValueError("top_k is negative")
    x = F.col("vector")
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    asked = queries.select(F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    if asked.where(~finite | (norm(x) < 1e-12)).limit(1).count():
        raise ValueError("a query vector is zero or not finite")
    rows = index.select(F.col("chunk_id").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector")).where(finite)
    buckets = rows.count() // BUCKET + 1
    entries = rows.select(F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("bucket"), F.lit(True).alias("entry"), "label", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), F.lit(False).alias("entry"), "label", "vector")
    both = entries.union(sent if top_k else sent.limit(0)).repartition("bucket").sortWithinPartitions("bucket", F.desc("entry"))
    found = both.mapInArrow(_past_entries(top_k, least), "label string, chunk_id string, similarity double")
    order = Window.partitionBy("label").orderBy(F.desc("similarity"), "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top_k)
    return ranked.withColumn("similarity", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity"))))


def _units(parts: list[pa.RecordBatch]) -> np.ndarray:
    x = np.concatenate([np.asarray(p.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(p.num_rows, -1) for p in parts])
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def _past_entries(top_k: int, least: float | None):
    """Walks buckets, whose entries come first, and gives the best of each for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, ids, units = None, [], None, None
        for batch in batches:
            kind = list(zip(batch.column("bucket").to_pylist(), batch.column("entry").to_pylist()))
            edges = [k for k in range(len(kind)) if not k or kind[k] != kind[k - 1]]
            for a, b in zip(edges, [*edges[1:], len(kind)]):
                if kind[a][0] != bucket:
                    bucket, held, units = kind[a][0], [], None
                if kind[a][1]:
                    held.append(batch.slice(a, b - a))
                    continue
                if units is None and held:
                    ids, units = np.array([i for p in held for i in p.column("label").to_pylist()], object), _units(held)
                for c in range(a, b if held else a, QUERIES):
                    some = batch.slice(c, min(QUERIES, b - c))
                    near, found = _units([some]) @ units.T, ([], [], [])
                    for label, score in zip(some.column("label").to_pylist(), near):
                        floor = np.partition(score, -top_k)[-top_k] if len(score) > top_k else -np.inf
                        keep = np.flatnonzero((score >= floor) & (score >= (least if least is not None else -np.inf)))
                        best = sorted(keep, key=lambda k: (-score[k], ids[k]))[:top_k]
                        found[0].extend([label] * len(best))
                        found[1].extend(ids[best].tolist())
                        found[2].extend(score[best].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], names=["label", "chunk_id", "similarity"])

    return run


def merge(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per chunk: its best similarity, and each query's."""
    return hits.groupBy(*(by or []), "chunk_id").agg(F.max("similarity").alias("similarity"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "similarity")))).alias("per_query"))


def affinity(applies_to: Column, fired: Column) -> tuple[Column, Column]:
    """(compatibility, tier): declared 0, unscoped 1, undeclared 2. Without fired signals or a declared scope all is unscoped."""
    unscoped = (F.size(fired) <= 0) | (F.size(applies_to) <= 0)
    kind = F.when(unscoped, "unscoped").when(F.arrays_overlap(applies_to, fired), "declared").otherwise("undeclared")
    return kind, F.when(kind == "declared", 0).when(kind == "unscoped", 1).otherwise(2)


def select_chunks(merged: DataFrame, final_k: int = 8, per_document: int | None = 2, by: list[str] | None = None, tier: str | None = None) -> DataFrame:
    """Ranks merged chunks (with document_id) and caps them: at most `per_document` of a document, then final_k in all; rank from 0.

    The order is tier (if given), similarity to 12 places descending, chunk_id.
    """
    by = by or []
    best = [*([tier] if tier else []), F.bround("similarity", 12).desc(), "chunk_id"]
    rows = merged
    if per_document is not None:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(*by, "document_id").orderBy(*best))).where(F.col("_d") <= per_document).drop("_d")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)) - 1).where(F.col("rank") < final_k)


def joined(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their vectors; an error where the text has changed since it was encoded, or an id or a model differs."""
    e = embeddings.withColumnRenamed("content_sha256", "_sha")
    both = chunks.join(e, "chunk_id")
    return both.where(F.when(F.col("_sha") != F.col("content_sha256"), F.raise_error(F.lit("a chunk's text isn't the one that was encoded")).cast("boolean")).otherwise(F.lit(True))).drop("_sha")


def index_problems(index: DataFrame) -> DataFrame:
    """(problem, n): repeated ids, several models or lengths, zero vectors; empty if the index is sound."""
    twice = index.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated id").alias("problem"), "n")
    rest = index.agg(F.countDistinct("model_name").alias("m"), F.countDistinct(F.size("vector")).alias("d"), F.count_if(norm(F.col("vector")) < 1e-12).alias("z"))
    problem = lambda name, n: F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n"))
    rest = rest.select(F.inline(F.array(problem("several models", F.col("m") - 1), problem("several lengths", F.col("d") - 1), problem("zero vector", F.col("z")))))
    return twice.union(rest).where("n > 0")
