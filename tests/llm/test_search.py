import numpy as np

from flowloom.llm import ann


def _exact(ids, x, k, every):
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        out[int(ids[q])] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 32)) + 1.5 * rng.normal(0, 1, (10, 32))[rng.integers(0, 10, 3000)]
    x[1200:1500] = x[1200]  # a crowd of copies
    ids = np.arange(3000)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, "vec_id % 50 = 0", 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = _exact(ids, x, 5, 50)
    assert set(got) == set(want) and all([r.rank for r in v] == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 5 for q in want]) >= 0.9
    assert [r.vec_id for r in got[1200]] == [1201, 1202, 1203, 1204, 1205]  # ties go to the smaller id
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    assert all(abs(r.score - unit[q] @ unit[r.vec_id]) < 1e-12 for q in got for r in got[q])


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(1)
    index = ann.MultiIndex(ann.unit(rng.normal(0, 1, (500, 8))), 20)
    first, second = rng.random(len(index.books[0])), rng.random(len(index.books[1]))
    steps = list(index.walk(first, second))
    sums = [first[i] + second[j] for _, i, j in steps]
    assert len({s[1:] for s in steps}) == len(first) * len(second) == len(steps) and sums == sorted(sums) == [s[0] for s in steps]


def test_small_buckets_agree(spark, monkeypatch):
    """Split and shared buckets give what one bucket gives; a walk over everything gives the exact rows."""
    rng = np.random.default_rng(2)
    x, ids = rng.normal(0, 1, (800, 6)), np.arange(800)
    x[100:400] = x[100] + 0.01 * x[100:400]  # a crowded first centroid
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK", 40)
    got = {}
    for r in ann.search(frame, "vec_id % 50 = 0", 5, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = _exact(ids, x, 5, 50)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.98


def test_clustered_vectors_are_found_in_few_cells():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (60, 32))
    x = ann.unit(centers[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(0, 1, (6000, 32)))
    index = ann.MultiIndex(x, 38)
    i, j = index.cells(x)
    np.add.at(index.counts, (i, j), 1)
    d1, d2 = index.halves(x[:100])
    near = x[:100] @ x.T
    near[np.arange(100), np.arange(100)] = -9
    share = []
    for q in range(100):
        met = {}
        total = 0
        for _, a, b in index.walk(d1[q], d2[q]):
            total += index.counts[a, b]
            met[a, b] = total
        share += [met[i[e], j[e]] / 6000 for e in np.argsort(-near[q])[:5]]
    assert np.quantile(share, 0.95) < 0.1


def test_any_finite_magnitude_counts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 8))
    tiny, huge = x[:10] * 1e-200, x[10:20] * 1e200
    rows = [(k, v.tolist()) for k, v in enumerate([*x, *tiny, *huge, np.full(8, 5e-324)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(frame, "vec_id % 50 = 0", 5).collect()
    assert len(found) == 9 * 5 and all(np.isfinite(r.score) for r in found)
    got = {(r.query_id, r.rank): r for r in found}
    assert got[0, 1].vec_id == 400 and abs(got[0, 1].score - 1) < 1e-12 and got[400, 1].vec_id == 0


def test_rows_of_one_id_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.6, 0.8]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.9, 0.1])]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", 5).collect())
    assert got == [(0, 1, 1, 0.8), (0, 2, 1, 0.684675), (0, 3, 0, 0.6)]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 2.0, 3.0]), (250, [1.0, 0.0]), (3, [float("inf"), 1.0])]
    frame = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "vec_id long, embedding array<double>, score double, i int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(frame, "vec_id % 50 = 0", 5).collect())
    assert got == [(0, 1, 250), (0, 2, 1), (250, 1, 0), (250, 2, 1)]
    assert ann.search(frame.limit(0), "vec_id % 50 = 0", 5).count() == 0
    assert ann.search(frame.where("vec_id = 0"), "vec_id % 50 = 0", 5).count() == 0


def test_multiples_of_a_vector_under_its_id_are_other_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", k=5).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 0, 1.0), (2, 1, 0.0)]
