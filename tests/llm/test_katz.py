import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowloom.llm import katz as K


def _model(docs, order):
    """Plain Katz over the training texts: probability(token, context), contexts, counts, texts, tokens."""
    texts = {i: (t or "").encode().lower().split() + ["END"] for i, t in docs}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for t in train for w in t)
    total = sum(one.values())
    grams = {n: Counter() for n in range(2, order + 1)}
    for t in train:
        t = ["START", *t]
        for n in grams:
            grams[n].update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))

    def ratios(counts):
        n = Counter(counts.values())
        return K.Discounts(np.array([n[r] for r in range(1, 7)])).ratio

    take = lambda r, c: c * (r[c - 1] if c <= 5 else 1.0)
    ratio = {1: ratios(one)} | {n: ratios(c) for n, c in grams.items()}
    unknown = 1 - sum(take(ratio[1], c) for c in one.values()) / total
    after = defaultdict(dict)
    for c in grams.values():
        for g, k in c.items():
            after[g[:-1]][g[-1]] = k
    weights = {}

    def p(w, h):
        if not h:
            return take(ratio[1], one[w]) / total if w in one else unknown
        if h not in after:
            return p(w, h[1:])
        seen, n, r = after[h], sum(after[h].values()), ratio[len(h) + 1]
        if h not in weights:
            mass = sum(take(r, c) for c in seen.values())
            scale = n / (n + 1) if mass > n - 1e-9 else 1.0
            weights[h] = scale, (1 - scale * mass / n) / (1 - sum(p(x, h[1:]) for x in seen))
        scale, weight = weights[h]
        return scale * take(r, seen[w]) / n if w in seen else weight * p(w, h[1:])

    return p, one, after, texts, total


def _check(rows, docs, order=2):
    p, one, after, texts, total = _model(docs, order)
    for h in [("START",), *sorted(after, key=str)[:: max(1, len(after) // 30)]]:
        assert abs(sum(p(w, h) for w in one) + p("never seen", h) - 1) < 1e-6
    for r in rows:
        t = texts[r.doc_id]
        before = ["START", *t]
        score = sum(math.log10(p(w, tuple(before[max(0, k + 2 - order) : k + 1]))) for k, w in enumerate(t))
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in one for w in t), total)
        assert abs(r.score - score) < 1e-6 * max(1, abs(score)) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_matches_a_plain_model(spark, corpus, folder):
    docs = [(d[0], d[1]) for d in corpus[0]]
    rows = K.score(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert len(rows) == len(docs)
    _check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_other_orders(spark, corpus, folder, monkeypatch, order):
    docs = [(d[0], d[1]) for d in corpus[0]]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    _check(K.score(frame, order=order).collect(), docs, order)
    monkeypatch.setattr(K, "CHUNK_ROWS", 7)
    monkeypatch.setattr(K, "BUCKET_TOKENS", 200)
    _check(K.score(frame, order=order).collect(), docs, order)


def test_small_chunks_and_split_contexts_agree(spark, corpus, monkeypatch):
    docs = [(d[0], d[1]) for d in corpus[0]]
    monkeypatch.setattr(K, "CHUNK_ROWS", 7)
    monkeypatch.setattr(K, "BUCKET_TOKENS", 200)
    frame = spark.createDataFrame(docs, "doc_id long, text string")  # not from files: written to the shared folder first
    _check(K.score(frame).collect(), docs)


def test_rows_in_another_order_than_their_files(spark, corpus, folder):
    """Shuffled, united and exploded rows are counted once each."""
    docs = [(d[0], d[1]) for d in corpus[0]]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    _check(K.score(frame.repartition(5)).collect(), docs)
    _check(K.score(frame.where("doc_id < 90").union(frame.where("doc_id >= 90"))).collect(), docs)
    twice = frame.selectExpr("explode(array(doc_id, doc_id + 1000)) as doc_id", "text")
    _check(K.score(twice).collect(), [(i + k, t) for i, t in docs for k in (0, 1000)])


def test_counts_beyond_32_bits():
    for x in ([0, 5, 2**32 - 1], [2**32 + 5, 1], []):
        assert K._unpack_counts(K._pack_counts(np.array(x, np.int64))).tolist() == x
    group = K.mix64(np.array([5], np.uint64))
    row = lambda n: {"bucket": 0, "chunk": n, "ids": K._pack(group, "<u8"), "counts": K._pack_counts(np.array([2**32 - 1]))}
    import pyarrow as pa

    told = K._merge_words(pa.Table.from_pylist([row(1), row(2)])).to_pylist()
    assert [K._unpack_counts(t["counts"]).tolist() for t in told[:2]] == [[2**33 - 2]] * 2


def test_odd_rows(spark, odd):
    rows = K.score(odd).collect()
    assert len(rows) == odd.count()
    assert all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3, 11)) and [r.held_out for r in rows if r.doc_id is None] == [None]
    assert K.score(odd.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [[10, 0, 0, 0, 0, 0], [0] * 6, [100, 50, 30, 20, 15, 12], [5, 9, 1, 7, 2, 30]])
def test_discounts_take_something_off_and_leave_something(counts):
    ratio = K.Discounts(np.array(counts)).ratio
    assert ((ratio > 0) & (ratio < 1)).all()
