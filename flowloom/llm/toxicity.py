"""Toxicity by a chain of linear classifiers.

The categories stand in a fixed order. The model of a category is a logistic regression on
the presence of hashed words and word beginnings and on the probabilities of all earlier
categories. While fitting, these probabilities come from models that haven't seen the row
(out-of-fold), so that a later model learns how far it can trust them.

Presence is for the whole text, so one term in a very long text weighs as much as in a short one.
The models are fitted on the driver on a bounded sample (SAMPLE_ROWS) of labelled rows; Spark
computes the features and picks, over that sample, the terms that tell a category best.

Defined results: null and empty texts have no term and get the models' prior, capped below the
threshold; a row teaches the categories whose label it has; repeated labels of an id count once, any 1 winning;
without positive labels all probabilities are 0; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, lean, steps, words
from .sampling import bounded, sample

SAMPLE_ROWS = 6_000
TERMS = 6_000
FOLDS = 3
THRESHOLD = 0.5
#: Word beginnings that are terms besides the word: their lengths in bytes.
BEGINNINGS = (4, 5)


class Terms(dict):
    """word -> its terms: hashes of the word and of its beginnings."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        hashed = [xxhash.xxh3_64_intdigest(word, 1) >> 1]
        hashed += [xxhash.xxh3_64_intdigest(word[:n], n) >> 1 for n in BEGINNINGS if len(word) > n]
        value = self[word] = tuple(hashed)
        return value


class Matched(dict):
    """word -> numbers of the chosen terms that it has."""

    def __init__(self, number: dict[int, int]):
        super().__init__()
        self.number, self.terms = number, Terms()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = tuple(self.number[t] for t in Terms.__missing__(self.terms, word) if t in self.number)
        return value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """L2 logistic regression on sparse rows (lists of term numbers) and a few dense columns; classes weigh alike up to a factor."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, n_terms: int, ridge: float = 1.0, rounds: int = 150):
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.concatenate(rows) if rows else np.empty(0, np.int64)
        k = dense.shape[1]
        weight = np.where(y > 0, min(4.0, (len(y) - y.sum()) / max(1, y.sum())), 1.0)
        w, first, second = np.zeros(n_terms + k + 1), 0.0, 0.0
        dense = np.hstack([dense, np.ones((len(rows), 1))])
        for step in range(1, rounds + 1):  # Adam over all rows
            z = np.bincount(at, w[term], len(rows)) + dense @ w[n_terms:]
            g = weight * (_sigmoid(z) - y)
            grad = np.append(np.bincount(term, g[at], n_terms), dense.T @ g) + ridge * np.append(w[:-1], 0)
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            w = w - 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.terms, self.dense = w[:n_terms].astype(np.float32), w[n_terms:].astype(np.float32)

    def probability(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        z = np.array([self.terms[r].sum() for r in rows]) + np.hstack([dense, np.ones((len(rows), 1))]) @ self.dense
        return _sigmoid(z)


class Chain:
    """The fitted models of the categories, in order. Labels are 0, 1 or -1 (unknown)."""

    def __init__(self, categories: list[str], rows: list[np.ndarray], labels: np.ndarray):
        self.categories, self.models = categories, []
        # The terms that occur in enough rows and tell a category best, by the difference of their shares' square roots.
        terms, count = np.unique(np.concatenate(rows) if rows else np.empty(0, np.int64), return_counts=True)
        common = terms[count >= 3]
        del terms, count

        def numbered(known: np.ndarray) -> list[np.ndarray]:
            found = [np.minimum(np.searchsorted(known, r), max(0, len(known) - 1)) for r in rows]
            return [f[known[f] == r] if len(known) else f[:0] for f, r in zip(found, rows)]

        local = numbered(common)
        gain = np.zeros(len(common))
        for j in range(len(categories)):
            share = []
            for side in (0, 1):
                mine = [r for r, y in zip(local, labels[:, j]) if y == side]
                share.append(np.bincount(np.concatenate(mine), minlength=len(common)) / len(mine) if mine and len(common) else np.zeros(len(common)))
            gain = np.maximum(gain, np.abs(np.sqrt(share[1]) - np.sqrt(share[0])))
        best = np.sort(np.argsort(-gain, kind="stable")[:TERMS])
        self.number = {int(common[k]): i for i, k in enumerate(best)}
        local = numbered(common[best])
        fold = np.arange(len(rows)) % FOLDS
        dense = np.empty((len(rows), 0))
        for j in range(len(categories)):
            y, known = labels[:, j].astype(float), labels[:, j] >= 0
            pick = lambda mask: ([local[k] for k in np.flatnonzero(mask)], dense[mask])  # noqa: B023, E731
            self.models.append(Logistic(*pick(known), y[known], len(best)))
            unseen = np.zeros(len(rows))
            for f in range(FOLDS if j + 1 < len(categories) else 0):
                model = Logistic(*pick(known & (fold != f)), y[known & (fold != f)], len(best))
                unseen[fold == f] = model.probability(*pick(fold == f))
            dense = np.hstack([dense, unseen[:, None]])

    def probabilities(self, texts: list[str | None], known: Matched) -> np.ndarray:
        rows, empty = [], []
        for t in texts:
            found = set(map(known.__getitem__, w := words(t)))
            rows.append(np.fromiter({k for terms in found for k in terms}, np.int64))
            empty.append(not w)
        dense = np.empty((len(rows), 0))
        for model in self.models:
            dense = np.hstack([dense, model.probability(rows, dense)[:, None]])
        dense[empty] = np.minimum(dense[empty], THRESHOLD / 2)
        return dense


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], limit: int = SAMPLE_ROWS) -> Chain | None:
    """Fits a chain of the categories (name -> SQL expression over the columns of `labels`, 0 or 1); None without labels of the last category."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(e).cast("int").alias(c) for c, e in categories.items()))
    marks = marks.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories)).dropna("all", subset=list(categories))
    chosen = sample(marks, list(categories), limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by `limit`
    rows = bounded(rows, limit + limit // 4)  # several documents may have one id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for whole in batches:
            for batch in steps(whole, "text"):
                found = [np.fromiter({k for w in set(words(t)) for k in terms[w]}, np.int64) for t in batch.column("text").to_pylist()]
                x = pa.array([np.sort(f).tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x, *(batch.column(c) for c in categories)], names=["doc_id", "x", *categories])

    got = rows.mapInArrow(lean(run), ", ".join(["doc_id long, x binary", *(f"{c} int" for c in categories)])).collect()
    if all(r[list(categories)[-1]] is None for r in got):
        return None
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    return Chain(list(categories), [np.frombuffer(bytes(r.x), np.int64) for r in got], np.array([[-1 if r[c] is None else r[c] for c in categories] for r in got]))


def _scored(batches: Iterator[pa.RecordBatch], chain: Chain | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    known = Matched(chain.number) if chain else None
    for whole in batches:
        for batch in steps(whole, "text"):
            texts = batch.column("text").to_pylist()
            yield batch, chain.probabilities(texts, known) if chain else np.zeros((len(texts), 1))


def predict(docs: DataFrame, chain: Chain | None, categories: list[str]) -> DataFrame:
    """doc_id, one probability column p_<category> for each category, and toxic (the last one reaches THRESHOLD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scored(batches, chain):
            p = p if chain else np.zeros((batch.num_rows, len(categories)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(categories))), pa.array(p[:, -1] >= THRESHOLD)],
                names=["doc_id", *(f"p_{c}" for c in categories), "toxic"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), ", ".join(["doc_id long", *(f"p_{c} double" for c in categories), "toxic boolean"]))


def keep_civil(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scored(batches, chain):
            yield batch.filter(pa.array(p[:, -1] < THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
