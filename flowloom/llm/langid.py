"""Language identification by hierarchical discrimination.

A text becomes the square roots of the relative frequencies of its hashed character
pairs and triples (of UTF-8 bytes, A-Z lower-cased, all but letters as one blank). Linear support vector
machines first tell the language family, one family from another, and then, within the family
that won, one language from another. Every decision is a vote of one-versus-one machines; ties go to the
larger sum of margins. The score is the weakest logistic margin among the winner's machines.

The machines are fitted on the driver on a bounded sample (SAMPLE_ROWS) of labelled rows,
whose features Spark computes; every text is read whole.

Defined results: a text that is null or has no letter is `und` with score 0; rows with a null id are judged like others;
repeated rows get equal results; without any labelled row every text is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, materialise, shared_dir, steps
from .sampling import sample

BITS = 12
BUCKETS = 1 << BITS
SAMPLE_ROWS = 6_000
#: Parts that scores are counted in, in each round of the search for one of them.
SCORE_BINS = 1_024
UNDETERMINED = "und"
#: The family of common languages by ISO 639-1 code; others are a family of their own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "is"],
    "romance": ["es", "fr", "it", "pt", "ca", "ro", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
}

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed byte pairs and triples."""
    raw = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]  # one blank between words
    two = raw[:-1] * np.uint32(256) + raw[1:]
    three = two[:-1] * np.uint32(256) + raw[2:]
    code = np.concatenate([(two * np.uint32(2654435761)) >> np.uint32(32 - BITS), ((three + np.uint32(1 << 24)) * np.uint32(2246822519)) >> np.uint32(32 - BITS)])
    count = np.bincount(code, minlength=BUCKETS).astype(np.float32)
    return np.sqrt(count / max(1, len(code)))


def _sparse(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers and values of the features that aren't zero."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes(), x[at].astype(np.float16).tobytes()


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, y in {-1, 1}; classes weigh alike. Newton steps by conjugate gradients.

    x is single precision and never copied: rows within the margin are told by their weights.
    """
    n, d = x.shape
    dot = lambda v: (x @ v.astype(np.float32)).astype(float)
    back = lambda v: (v.astype(np.float32) @ x).astype(float)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n * cost / n * 100
    w, b = np.zeros(d), 0.0
    for _ in range(rounds):
        margin = 1 - y * (dot(w) + b)
        ws = np.where(margin > 0, weight, 0.0)
        grad = w - back(ws * y * margin)
        grad_b = -(ws * y * margin).sum()

        def times(v):
            z = ws * (dot(v[:-1]) + v[-1])
            return np.append(v[:-1] + back(z), z.sum() + 1e-6 * v[-1])

        r = -np.append(grad, grad_b)
        if np.linalg.norm(r) < 1e-3 * np.sqrt(d):
            break
        v, p, rr = np.zeros(d + 1), r.copy(), r @ r
        for _ in range(25):
            q = times(p)
            a = rr / (p @ q)
            v += a * p
            r -= a * q
            rr, old = r @ r, rr
            if rr < 1e-6:
                break
            p = r + rr / old * p
        loss = lambda s: 0.5 * ((w + s * v[:-1]) ** 2).sum() + 0.5 * (weight * np.maximum(0, 1 - y * (dot(w + s * v[:-1]) + b + s * v[-1])) ** 2).sum()
        at, s = loss(0), 1.0
        while loss(s) > at and s > 1e-3:
            s /= 2
        w, b = w + s * v[:-1], b + s * v[-1]
    return w.astype(np.float32), float(b)


class Machines:
    """One-versus-one machines over some classes."""

    def __init__(self, classes: list[str], x: np.ndarray, labels: np.ndarray):
        self.classes, self.pairs, weights, biases = classes, list(combinations(range(len(classes)), 2)), [], []
        for a, b in self.pairs:
            rows = (labels == classes[a]) | (labels == classes[b])
            w, bias = fit_svm(x if rows.all() else x[rows], np.where(labels[rows] == classes[a], 1.0, -1.0))
            weights.append(w)
            biases.append(bias)
        self.weights = np.array(weights, np.float32).reshape(-1, x.shape[1]).T
        self.biases = np.array(biases, np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, score) of each row."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margin = x @ self.weights + self.biases
        votes, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            m = margin[:, j]
            for c, s in ((a, m), (b, -m)):
                votes[:, c] += s > 0
                total[:, c] += s
                least[:, c] = np.minimum(least[:, c], s)
        best = np.lexsort((-np.arange(k) * np.ones((n, 1)), total, votes), axis=1)[:, -1]
        return best, 1 / (1 + np.exp(-3.0 * np.clip(least[np.arange(n), best], -20, 20)))


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs)
        families = np.array([family(v) for v in langs])
        self.families = Machines(sorted(set(families)), x, families)
        self.within = {f: Machines(sorted(set(labels[families == f])), x[families == f], labels[families == f]) for f in self.families.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        first, score = self.families.decide(x)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families.classes):
            rows = np.flatnonzero(first == k)
            if len(rows):
                at, s = self.within[f].decide(x[rows])
                out[rows] = np.array(self.within[f].classes, object)[at]
                score[rows] = np.minimum(score[rows], s)
        return out.tolist(), score


def fit(train: DataFrame, limit: int = SAMPLE_ROWS) -> Hierarchy | None:
    """Fits on a bounded sample of (doc_id, text, lang); None if no row has a language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                rows = [(lang, *_sparse(features(t))) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if has_letter(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["lang", "at", "x"])

    labelled = train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    rows = sample(labelled, ["lang"], limit).mapInArrow(lean(run), "lang string, at binary, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.x)))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(bytes(r.at), np.uint16)] = np.frombuffer(bytes(r.x), np.float16)
    return Hierarchy(x, [r.lang for r in rows])


def _judge(batch: pa.RecordBatch, model: Hierarchy | None) -> tuple[list[str], np.ndarray]:
    texts = batch.column("text").to_pylist()
    pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    rows = [k for k, t in enumerate(texts) if model and has_letter(t)]
    for a in range(0, len(rows), 1024):
        some = rows[a : a + 1024]
        langs, s = model.predict(np.stack([features(texts[k]) for k in some]))
        score[some] = s
        for k, lang in zip(some, langs):
            pred[k] = lang
    return pred, score


def predict(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                pred, score = _judge(batch, model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Hierarchy | None, least: float) -> DataFrame:
    """The rows whose language is determined with a score of `least` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                pred, score = _judge(batch, model)
                yield batch.filter(pa.array([p != UNDETERMINED and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def kth_least(scores: DataFrame, k: int) -> float:
    """The k-th least of the scores (score), from 1 on, exactly: counts in equal parts of a range, then within the part that holds it, until all in it are equal."""
    inside, at = scores, F.lit(0)
    while True:
        parts = inside.groupBy(at.alias("part")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("part").collect()
        for part in parts:
            if k <= part.n:
                break
            k -= part.n
        if part.lo == part.hi:
            return part.lo
        inside = scores.where(F.col("score").between(part.lo, part.hi))
        at = F.floor((F.col("score") - part.lo) / (part.hi - part.lo) * SCORE_BINS)  # its ends are never in one part, so each round leaves less


def calibrated(train: DataFrame, share: float, floor: float) -> tuple[Hierarchy | None, float]:
    """A model, and the least score that rejects at most `share` of the texts whose language it tells right.

    A third of the labelled rows, by a hash of the id, is kept from the model, and the score is a low rank among those of them
    that it tells right: the k-th of n, k = share * (n + 1) rounded down. All kept rows count, whose scores stay in the shared folder.
    Where they are too few for that rank, all rows are learnt from and `floor` is the score.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3))
    held = train.where("lang is not null").where(part == 0)
    n = held.count()
    if share * (n + 1) < 1:
        return fit(train), floor
    model = fit(train.where(part != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                pred, score = _judge(batch, model)
                yield pa.RecordBatch.from_arrays([pa.array(score[np.array(pred) == np.array(batch.column("lang").to_pylist())])], names=["score"])

    rows = held.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scores = materialise(rows.mapInArrow(lean(run), "score double"), f"{shared_dir(train.sparkSession)}/scores")
    k = int(share * (scores.count() + 1))
    return model, max(floor, kth_least(scores, k)) if k else floor


def training_rows(documents: DataFrame) -> DataFrame:
    """The rows that the contract lets a model learn from."""
    return documents.where(crc_mod("doc_id", 3) != 1)
