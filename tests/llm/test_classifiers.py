import random

import numpy as np
import pytest
from brute_force import language_of, toxicity_of
from pyspark.sql import functions as F

from flowloom.llm import langid, queries, quality, toxicity
from flowloom.llm.sampling import sample


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_language_on_held_out_documents(spark, folder):
    docs, _ = _docs(spark, folder)
    got = queries.op2_hierarchical_langid(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_families_come_first():
    rng = np.random.default_rng(0)
    centers = {"de": [4, 0, 1, 0], "en": [4, 0, 0, 1], "es": [0, 4, 1, 0], "fr": [0, 4, 0, 1]}
    langs = [k for k in centers for _ in range(40)]
    x = np.array([centers[k] for k in langs]) + rng.normal(0, 0.1, (160, 4))
    model = langid.Hierarchy(x.astype(np.float32), langs)
    assert model.families.classes == ["germanic", "romance"] and set(model.within) == {"germanic", "romance"}
    assert model.predict(x.astype(np.float32))[0] == langs


def test_votes_against_plain_loops(spark, folder):
    """Every prediction again, machine by machine."""
    docs, _ = _docs(spark, folder)
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in langid.predict(docs, model).collect():
        lang, score = language_of(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


@pytest.mark.parametrize("text", ["½", "²", "3 ½ ²", "_", "١٢"])
def test_numbers_and_signs_are_no_letters(spark, folder, text):
    model = langid.fit(_docs(spark, folder)[0])
    assert langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().lang_pred == "und"


def test_language_of_odd_rows(spark, odd, folder):
    docs, _ = _docs(spark, folder)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3, 4, 11)) and got[7].lang_pred != "und"
    kept = langid.keep_identified(odd, model, 0.0)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 9, 10, None}
    assert langid.fit(odd) is None and langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd.limit(0), model).count() == 0


def test_toxic_documents_are_caught(spark, folder):
    _, labels = _docs(spark, folder)
    got = queries.op3_toxicity_chain(spark, folder).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    wrong = [r.doc_id for r in got if r.toxic != bool(r.label)]
    assert len(got) == 160 and len(wrong) <= 2


def test_chain_feeds_earlier_probabilities():
    """The second category is the first one's opposite and has no term of its own: only the fed probability tells it."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(400):
        first = rng.random() < 0.5
        rows.append(np.array([1 if first else 2, *(10 + rng.randrange(50) for _ in range(3))]))
        labels.append((int(first), int(not first)))
    chain = toxicity.Chain(["first", "second"], rows, np.array(labels))
    assert len(chain.models[1].dense) == 2 and chain.models[1].dense[0] < -0.5


def test_chain_against_plain_sums(spark, folder):
    """Every probability again, term by term, in the order of the chain."""
    docs, labels = _docs(spark, folder)
    chain = toxicity.fit(docs, labels, queries.TOXICITY)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.predict(docs, chain, list(queries.TOXICITY)).collect():
        want = toxicity_of(chain, texts[r.doc_id])
        assert all(abs(r[f"p_{c}"] - p) < 1e-4 for c, p in zip(chain.categories, want)) and r.toxic == (want[-1] >= toxicity.THRESHOLD)


def test_a_row_teaches_what_it_is_labelled_with(spark, folder):
    docs, labels = _docs(spark, folder)
    half = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))  # no toxic label is lost with it
    chain = toxicity.fit(docs, half, queries.TOXICITY)
    got = toxicity.predict(docs, chain, list(queries.TOXICITY)).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    assert sum(r.toxic != bool(r.label) for r in got) <= 2


def test_toxicity_of_odd_rows(spark, odd, folder):
    docs, labels = _docs(spark, folder)
    chain = toxicity.fit(docs, labels, queries.TOXICITY)
    got = toxicity.predict(odd, chain, list(queries.TOXICITY))
    assert got.count() == odd.count() and got.where("toxic").count() == 0
    assert toxicity.keep_civil(odd, chain).columns == odd.columns
    assert toxicity.fit(docs, labels.limit(0), queries.TOXICITY) is None
    assert toxicity.predict(odd, None, list(queries.TOXICITY)).where("toxic").count() == 0
    assert toxicity.keep_civil(odd, None).count() == odd.count()
    unlabelled = labels.select("doc_id", "quality", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.fit(docs, unlabelled, queries.TOXICITY) is None


def test_quality_on_held_out_documents(spark, folder):
    _, labels = _docs(spark, folder)
    got = queries.op7_additive_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert got and all(r.predicted == r.quality for r in got)


def test_quality_against_plain_sums(spark, folder):
    """Every score again, table by table."""
    docs, labels = _docs(spark, folder)
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality.predict(docs, model).collect():
        x = quality.features(texts[r.doc_id])
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
        coarse = [b * quality.PAIR_BINS // len(t) for b, t in zip(bins, model.tables)]
        z = model.start + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[coarse[a]][coarse[b]] for (a, b), t in zip(model.pairs, model.joint))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.Additive(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85


def test_quality_of_odd_rows(spark, odd, folder):
    docs, labels = _docs(spark, folder)
    model = quality.fit(docs, labels)
    rows = quality.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3, 11)}) == 1
    assert {r.score for r in quality.predict(odd, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.predict(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("limit", [40, 10_000])
def test_samples_are_bounded_and_stratified(spark, limit):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, "rare").otherwise("common").alias("kind"))
    got = {r.kind: r["count"] for r in sample(rows, ["kind"], limit).groupBy("kind").count().collect()}
    assert sum(got.values()) <= max(1.6 * limit, 100) and got["rare"] >= min(10, limit // 4)
    if limit > 5000:
        assert got == {"rare": 50, "common": 4950}


@pytest.mark.parametrize("limit", [40, 5_000, 15_000])
def test_samples_are_bounded_whatever_the_ids(spark, limit):
    """Rows without an id, three ids of all rows, and one row twenty thousand times."""
    ids = {"none": "cast(null as long)", "three": "id % 3", "one": "cast(7 as long)"}
    for name, of in ids.items():
        text = "'same'" if name == "one" else "concat('t', id)"
        rows = spark.range(20_000).selectExpr(f"{of} as doc_id", f"{text} as text", "'en' as lang")
        got = sample(rows, ["lang"], limit).count()
        assert got <= limit * 5 // 4 and got >= (limit // 2 if name != "one" else 1), (name, got)


def test_fits_are_bounded_where_documents_share_an_id(spark):
    from flowloom.llm import quality, toxicity

    docs = spark.range(3_000).selectExpr("id % 2 as doc_id", "concat('some words here ', id) as text")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels, {"toxic": "toxic"}, limit=100) is not None
    assert quality.fit(docs, labels, limit=100) is not None


def test_the_threshold_is_a_rank_among_all_kept_rows(spark, monkeypatch):
    """No sample: the least score is met in every table, however many rows there are."""
    rng = np.random.default_rng(4)
    values = np.concatenate([1 - rng.random(3_000) ** 8, np.full(500, 0.25), [0.25 + 1e-16, 5e-324, 0.0, 1.0]])
    scores = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(5)
    for k in (1, 2, 3, 250, 504, 2_000, len(values)):
        assert langid.kth_least(scores, k) == sorted(values)[k - 1]
    n = 40_000  # more than the 12,000 rows that were looked at
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    monkeypatch.setattr(langid, "fit", lambda train, *_: "model")
    monkeypatch.setattr(langid, "_judge", lambda batch, model: (["en"] * batch.num_rows, np.array([int(t[5:]) / 40_000 for t in batch.column("text").to_pylist()])))
    held = sorted(r.doc_id for r in docs.where("pmod(xxhash64(doc_id, 11), 3) = 0").collect())
    assert langid.calibrated(docs, 0.005, 0.0) == ("model", held[int(0.005 * (len(held) + 1)) - 1] / n)
