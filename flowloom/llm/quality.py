"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and a few pairs of features have
one over their joint bins. The tables grow by cyclic boosting: round after round, each
feature in turn gets a small step from a shallow tree (at most LEAVES leaves over its bins)
fitted to the current log-loss gradients. The pairs are those whose joint bins lower the remaining loss
most; they are boosted in the same way afterwards. Scoring adds one table entry for each feature and pair.

The tables are fitted on the driver on a bounded sample (SAMPLE_ROWS) of labelled rows, whose features
Spark computes over whole texts.

Defined results: a null or empty text has all features 0 and gets the tables' score for that;
rows without a label don't teach, repeated labels of an id count once (the lowest wins); without labels every score is 0.5;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps
from .sampling import bounded, sample

SAMPLE_ROWS = 12_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
LEAVES = 3
ROUNDS = 150
RATE = 0.15

FEATURES = [
    "log_words", "word_length", "long_words", "upper_share", "upper_words", "digit_share", "mark_share", "marks_inside",
    "top_word", "top_four", "distinct", "repeats_next", "lines_per_word", "line_repeats", "single_letters", "other_share",
]

# Byte classes: 0 blank, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 other ASCII marks, 6 beyond ASCII, 7 control.
_CLASS = np.array(
    [0 if b in b" \t\n\r\x0b\x0c" else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in b".,;:?'\"()-" else 6 if b > 127 else 7 if b < 32 or b == 127 else 5 for b in range(256)],
    np.uint8,
)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    items = raw.split()
    n = len(items)
    if not n:
        return [0.0] * len(FEATURES)
    kind = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    solid = max(1, len(raw) - int(kind[0]))
    letters = max(1, int(kind[1] + kind[2] + kind[6]))
    count = Counter(items)
    top = sorted(count.values(), reverse=True)[:4]
    lines = raw.split(b"\n")
    shapes = list(count.items())
    upper = sum(c for w, c in shapes if w.isupper())
    inside = sum(c for w, c in shapes if not w.rstrip(b".,;:?!'\")-").isalnum() and w.isascii())
    return [
        np.log1p(n),
        solid / n,
        sum(c for w, c in shapes if len(w) > 16) / n,
        kind[2] / letters,
        upper / n,
        kind[3] / solid,
        kind[5] / solid,
        inside / n,
        top[0] / n,
        sum(top) / n,
        len(count) / n,
        sum(map(bytes.__eq__, items, items[1:])) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in shapes if len(w) == 1) / n,
        kind[7] / solid,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(gradient: np.ndarray, curvature: np.ndarray, leaves: int) -> np.ndarray:
    """Steps for consecutive bins from a tree with at most `leaves` leaves, grown by the best cut."""
    parts = [(0, len(gradient))]
    score = lambda a, b: gradient[a:b].sum() ** 2 / (curvature[a:b].sum() + 1.0)
    while len(parts) < leaves:
        best = None
        for a, b in parts:
            if b - a > 1:
                left_g, left_h = np.cumsum(gradient[a:b])[:-1], np.cumsum(curvature[a:b])[:-1]
                right_g, right_h = gradient[a:b].sum() - left_g, curvature[a:b].sum() - left_h
                gain = left_g**2 / (left_h + 1.0) + right_g**2 / (right_h + 1.0) - score(a, b)
                k = int(gain.argmax())
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], (a, b), a + k + 1)
        if best is None:
            break
        a, b = best[1]
        parts[parts.index((a, b))] = (a, best[2])
        parts.append((best[2], b))
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (curvature[a:b].sum() + 1.0)
    return out


def _joint_tree(gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Steps for joint bins from the best tree that cuts the first feature once and the second once on either side."""
    best, out = -1.0, np.zeros_like(gradient)
    for cut in range(1, len(gradient)):
        step, gain = np.zeros_like(gradient), 0.0
        for side in (slice(0, cut), slice(cut, None)):
            g, h = gradient[side].sum(0), curvature[side].sum(0)
            step[side] = _tree(g, h, 2)
            gain += float((step[side][0] * g).sum())
        if gain > best:
            best, out = gain, step
    return out


class Additive:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        bins = self._bins(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(n, self.start)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                p = _sigmoid(z)
                step = RATE * _tree(np.bincount(bins[j], y - p, len(table)), np.bincount(bins[j], p * (1 - p), len(table)), LEAVES)
                table += step
                z += step[bins[j]]
        # The pairs that lower what loss remains the most.
        coarse = [b * PAIR_BINS // len(t) for b, t in zip(bins, self.tables)]
        p, gains = _sigmoid(z), []
        g, h = y - p, p * (1 - p)
        for a in range(d):
            for b in range(a + 1, d):
                cell = coarse[a] * PAIR_BINS + coarse[b]
                gg, hh = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
                gains.append((float((gg**2 / (hh + 1.0)).sum()), -a, -b))
        self.pairs = [(-a, -b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.joint = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(ROUNDS // 3):
            for (a, b), table in zip(self.pairs, self.joint):
                p = _sigmoid(z)
                cell = coarse[a] * PAIR_BINS + coarse[b]
                gg = np.bincount(cell, y - p, PAIR_BINS**2).reshape(PAIR_BINS, -1)
                hh = np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, -1)
                step = RATE * _joint_tree(gg, hh)
                table += step
                z += step[coarse[a], coarse[b]]

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        z = np.full(len(x), self.start)
        for b, table in zip(bins, self.tables):
            z += table[b]
        for (a, b), table in zip(self.pairs, self.joint):
            z += table[bins[a] * PAIR_BINS // len(self.tables[a]), bins[b] * PAIR_BINS // len(self.tables[b])]
        return _sigmoid(z)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Additive | None:
    """Fits on a bounded sample of `labels` (doc_id, quality 0 or 1) joined to (doc_id, text); None without labelled rows."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    marks = sample(marks.groupBy("doc_id").agg(F.min("quality").alias("quality")), ["quality"], limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")  # bounded by `limit`
    rows = bounded(rows, limit + limit // 4)  # several documents may have one id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(_matrix(batch)), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.x))
    return Additive(np.array([r.x for r in got]), np.array([r.quality for r in got], float))


def predict(docs: DataFrame, model: Additive | None, least: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from `least`) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                score = model.score(_matrix(batch)) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
