"""Fill-in-the-middle, resampling and fingerprints against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute_force import words_of
from pyspark.sql import functions as F

from flowloom.llm import fim, fingerprint, queries, resample

ODD = [None, "", "\n", "\n\n", "a", "é", "a\n", "\na", "日本語 abc 😀😀x", "a" * 30_000, "é" * 20_000, "ab " * 9_000, "ab \n" * 3_000, "<P", "x<P>y", "one two", "one two", "two one", "b\na", "a\nb"]


def some_texts(seed: int) -> list:
    rng = random.Random(seed)
    made = ["".join(rng.choice("abcXYZ  \n.é日😀<PSM>1") for _ in range(rng.choice([3, 50, 500, 5_000, 30_000]))) for _ in range(60)]
    shared = made[3] + made[4] * 3
    return ODD + made + [x + shared + x for x in made[:10]] + made[:5]


def middle_of(doc_id, text):
    """The contract, word by word."""
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, text
    u, v = sorted(x % (len(w) + 1) for x in h[:2])
    a, b, z = "".join(w[:u]), "".join(w[u:v]), "".join(w[v:])
    if h[3] % 100 < 20:
        return doc_id, len(w), "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return doc_id, len(w), "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


def frame(spark, rows):
    extra = [F.lit(k).alias(k) for k in ("n", "form", "output", "rank", "score", "weight", "key", "range", "guest", "place", "next_text", "bucket")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *extra)


def test_middles_match_the_contract(spark):
    rows = list(enumerate(some_texts(1))) + [(None, "no id here at all"), (7, "a b c"), (7, "a b c")]
    got = fim.transform(frame(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((middle_of(*r) for r in rows), key=str)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert all(r.back in texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(frame(spark, rows).where("false")).count() == 0


def test_chunks_are_shared_wherever_a_passage_stands():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(1000)) for _ in range(n))
    passage = prose(3_000)
    texts = [prose(rng.randrange(5, 50)) + passage + prose(rng.randrange(5, 50)) for _ in range(20)]
    chunks = fim.Chunks()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(20), pa.int64()), "text": pa.array(texts, pa.string())})
    for part in (batch.slice(0, 1), batch.slice(1)):
        for got in fim._transform(part, 1, chunks).to_pylist():
            assert tuple(got.values()) == middle_of(got["doc_id"], texts[got["doc_id"]])
    assert chunks.counted < 0.2 * chunks.asked


def test_chunks_of_texts_without_bounds():
    data = np.frombuffer(("é" * 50_000).encode(), np.uint8)
    at = fim.chunk_starts(data, np.array([0, 40_000]), np.array([40_000, 100_000]))
    assert 0 in at and 40_000 in at and np.diff(np.append(at, 100_000)).max() <= fim.LONGEST + 3 and not (data[at] & 0xC0 == 0x80).any()


def test_chunk_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(fim, "CACHE_BYTES", 1_000)
    texts, chunks = some_texts(3), fim.Chunks()
    for k in range(0, len(texts), 7):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(k, min(k + 7, len(texts))), pa.int64()), "text": pa.array(texts[k : k + 7], pa.string())})
        assert [tuple(r.values()) for r in fim._transform(batch, 1, chunks).to_pylist()] == [middle_of(k + j, t) for j, t in enumerate(texts[k : k + 7])]


def features_of(text):
    w = [x.encode() for x in words_of(text)]
    return w + [a + b" " + b for a, b in zip(w, w[1:])]


def resampled(docs, targets, percent=25, least=20):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, text in docs:
        for f in features_of(text):
            s[zlib.crc32(f) % 10_000] += 1
    for text in targets:
        for f in features_of(text):
            t[zlib.crc32(f) % 10_000] += 1
    gain = [math.floor(1000 * math.log((int(y) + 1.0) * (int(t.sum()) * 0 + int(s.sum()) + 10_000) / ((int(x) + 1.0) * (int(t.sum()) + 10_000)))) for x, y in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        f = features_of(text)
        weight = sum(gain[zlib.crc32(x) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    rest = list(rows)
    for r in drawn:
        rest.remove(r)
    return [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest]


def resample_rows(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(300)] + ["é", "日本", "x" * 31, "x" * 32, "x" * 33, "y" * 5_000]
    text = lambda: " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 60])))
    docs = [(k, text()) for k in range(150)] + [(150, None), (151, ""), (152, "!!!"), (None, "a " * 30), (None, text())]
    docs += [(153, "same words here " * 10)] * 60 + [(154 + k, docs[3][1]) for k in range(20)] + [(200, "z" * 200_000 + " end"), (201, "many " * 40_000)]
    return docs, [text() for _ in range(20)] + [None, ""]


def test_draws_match_brute_force(spark):
    docs, targets = resample_rows(4)
    got = resample.resample(frame(spark, docs), spark.createDataFrame([(t,) for t in targets], "text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(resampled(docs, targets), key=str)
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20


def test_draws_from_nothing(spark):
    docs, targets = resample_rows(5)
    empty = frame(spark, docs).where("false")
    assert resample.resample(empty, empty).count() == 0
    got = resample.resample(frame(spark, docs[:8]), empty).collect()
    assert sorted(map(tuple, got), key=str) == sorted(resampled(docs[:8], []), key=str)


def test_pair_crcs_follow_from_words():
    rng = random.Random(6)
    texts = [[bytes(rng.randrange(128, 256) for _ in range(rng.choice([1, 3, 31, 32, 33, 100]))) for _ in range(20)], [], [b"one"]]
    crcs, row = resample.feature_crcs(texts, resample.WordCodes())
    want = [zlib.crc32(w) for t in texts for w in t] + [zlib.crc32(a + b" " + b) for t in texts for a, b in zip(t, t[1:])]
    assert crcs.tolist() == want and row.tolist() == [0] * 20 + [2] + [0] * 19


@pytest.mark.parametrize("pivots", [1, 2, 32])
def test_quickselect_finds_each_key(spark, tmp_path, monkeypatch, pivots):
    monkeypatch.setattr(resample, "PIVOTS", pivots)
    rng = random.Random(pivots)
    rows = [(rng.randrange(5), rng.choice([None, *range(10)]), 1, 1, k) for k in range(40)]
    keys = resample._keyed(spark.createDataFrame(rows, "score long, doc_id long, n_features long, weight long, place long"))
    order = [r[4] for r in sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, *r[2:]))]
    place = {bytes(r.key): r.place for r in keys.collect()}
    assert [place[k] for k in sorted(place)] == order
    for k in (1, 17, 40):
        assert place[resample.kth_key(keys, k, f"{tmp_path}/{k}")] == order[k - 1]
    assert resample.kth_key(keys, 41, f"{tmp_path}/41") is None and resample.kth_key(keys, 0, f"{tmp_path}/0") is None


def print_of(text) -> str:
    """The fingerprint by plain sums over paragraphs."""
    lanes, sketch = [0] * fingerprint.LANES, [0] * fingerprint.SKETCH
    for p in (text or "").encode().split(b"\n") if text else []:
        digest = hashlib.shake_128(p).digest(4 * fingerprint.LANES)
        for k in range(fingerprint.LANES):
            lanes[k] = (lanes[k] + int.from_bytes(digest[4 * k : 4 * k + 4], "little")) % 2**32
        _, alone = fingerprint.Vectors().of([[p]])
        for k, v in enumerate(alone[0].tolist()):
            sketch[k] = (sketch[k] + v) % 2**16
    return "".join(f"{v:08x}" for v in lanes) + "".join(f"{v:04x}" for v in sketch)


def edited_of(rows: list) -> list:
    """(row, edited text, next text) in the order of ids downwards."""
    key = lambda r: (r[0] is None, -(r[0] or 0))
    order = sorted(rows, key=key)
    out = []
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + other[:half], t, other))
    return out


@pytest.mark.parametrize("size", [200, 50_000, 8 << 20])
def test_edits_match_brute_force(spark, monkeypatch, size):
    """Whatever the ranges: one, some, or about one a row."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", size)
    texts = some_texts(7) + ["first line\nsecond line of words here\nthird\n" * 4, None]
    rng = random.Random(8)
    ids = rng.sample(range(-50, 10_000), len(texts))
    rows = list(zip(ids, texts))
    got = fingerprint.spliced(frame(spark, rows)).collect()
    wanted = edited_of(rows)
    assert sorted((r.doc_id, r.n_chars, r.edited) for r in got) == sorted(w[:3] for w in wanted)
    of = {w[0]: w for w in wanted}
    for r in got:
        _, _, edited, text, other = of[r.doc_id]
        assert r.fingerprint == print_of(text) and r.edited_fingerprint == print_of(edited)
        a, b, c = (tuple(x[None] for x in fingerprint.from_text(print_of(t))) for t in (text, edited, other))
        assert r.near_edited == fingerprint.likeness(a, b)[0] and r.near_next == fingerprint.likeness(a, c)[0]


def test_edits_of_odd_tables(spark):
    one = fingerprint.spliced(frame(spark, [(5, "abcd")])).collect()
    assert [(r.doc_id, r.edited) for r in one] == [(5, "abab")]
    assert fingerprint.spliced(frame(spark, [(5, "x")]).where("false")).count() == 0
    rows = [(1, "hot text")] * 50 + [(1, "other"), (None, "none\nhere"), (2, None)]
    got = fingerprint.spliced(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {1, 2, None}
    assert next(r.edited for r in got if r.doc_id is None) == "none\n"  # followed by the first row, whose text is null


def test_fingerprints_know_neither_order_nor_way(spark):
    v = fingerprint.Vectors()
    a, b, c = b"one two three four", b"five six", b""
    p, q = v.of([[a, b, c, b]]), v.of([[b, c, a, b]])
    assert fingerprint.as_text(p) == fingerprint.as_text(q) != fingerprint.as_text(v.of([[a, b, c]]))
    assert fingerprint.as_text(fingerprint.remove(p, v.of([[b]]))) == fingerprint.as_text(v.of([[a, b, c]]))
    assert fingerprint.as_text(fingerprint.add(v.of([[a, c]]), v.of([[b, b]]))) == fingerprint.as_text(p)
    rows = [(1, "a b c\nd"), (2, "d\na b c"), (3, "d\na b c\n"), (4, None), (5, "")]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] and {i: print_of(t) for i, t in rows} == got


def test_likeness_tells_shares(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    near, far = [], []
    for _ in range(30):
        x, y = prose(200), prose(200)
        v = fingerprint.Vectors().of([[" ".join(x).encode()], [" ".join(x[:100] + y[:100]).encode()], [" ".join(y).encode()]])
        row = lambda k: (v[0][k : k + 1], v[1][k : k + 1])
        near.append(fingerprint.likeness(row(0), row(1))[0])
        far.append(fingerprint.likeness(row(0), row(2))[0])
    assert abs(np.mean(near) - 0.5) < 0.05 and np.mean(far) < 0.1 and min(near) > max(far)


def test_queries_match_the_contracts(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op11_chunk_memo_fim(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((*(m := middle_of(i, t))[:5], sha(m[5]), sha(t or "")) for i, t in docs)
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op13_multiset_fingerprint(spark, folder).collect()}
    assert got == {i: (n, sha(edited), print_of(text), print_of(edited)) for i, n, edited, text, _ in edited_of(docs)}
