import random

from brute_force import components_of, contamination_of, language_of, toxicity_of

import corpus_pipeline as P
from flowloom.llm import langid, toxicity
from flowloom.llm.queries import TOXICITY


def _rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = langid.fit(langid.training_rows(docs))
    one = P.language(spark, docs, folder)
    told = {i: language_of(model, t) for i, t in _rows(docs).items()}
    assert set(_rows(one)) == {i for i, (lang, score) in told.items() if lang != "und" and score >= 0.5} and one.columns == docs.columns
    two = P.civil(spark, one, folder)
    chain = toxicity.fit(one, labels, TOXICITY)
    bad = {i for i, t in _rows(one).items() if toxicity_of(chain, t)[-1] >= toxicity.THRESHOLD}
    assert set(_rows(two)) == set(_rows(one)) - bad and two.columns == docs.columns
    kept = _rows(two)
    three = P.distinct(spark, two, folder)
    classes = components_of(sorted(kept.items()))
    assert set(_rows(three)) == {i for i in kept if classes[i] == i} and three.columns == docs.columns
    four = P.uncontaminated(spark, three, folder)
    judged = {i: contamination_of(t, corpus[1]) for i, t in _rows(three).items()}
    assert set(_rows(four)) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)} and four.columns == docs.columns
    out = P.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == set(_rows(four)) and out.where("n_tokens <> size(token_ids)").count() == 0
    clean = {d[0] for d, label in zip(corpus[0], corpus[2]) if label[2] == 0 and d[3] != "leak"}
    assert len(clean & {r.doc_id for r in out.collect()}) >= 0.9 * len({i for i in clean if components_of([(d[0], d[1]) for d in corpus[0]])[i] == i})


def test_stages_take_odd_rows(spark, odd, folder):
    for name, stage in P.STAGES:
        out = stage(spark, odd, folder)
        assert out.count() <= odd.count(), name
        assert stage(spark, odd.limit(0), folder).count() == 0, name
        if name != "pieces":
            assert set(out.columns) == set(odd.columns), name
    once = P.distinct(spark, odd, folder).collect()
    assert sorted(r.doc_id or 0 for r in once) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11]


def test_texts_in_no_learnt_language_go(spark, corpus):
    rng = random.Random(5)
    known = {lang: " ".join(d[1] for d in corpus[0] if d[2] == lang and d[3] != "leak").split(" ") for lang in ("en", "de", "es", "fr")}
    docs = [(k, " ".join(rng.choices(known[lang], k=60)), lang, "s", 0) for k in range(1200) for lang in [["en", "de", "es", "fr"][k % 4]]]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神互相对待。",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(100)),
        rng.randbytes(300).hex(),
    ]
    rows = docs + [(5000 + k, text, None, "s", 0) for k, text in enumerate(other)]
    kept = set(_rows(P.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")))
    assert not kept & set(range(5000, 5000 + len(other)))
    assert len(kept) >= 0.98 * len(docs)


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, "one two three four five six", "en", "b", 1), (1, "other words stand in this row", "en", "b", 1), (1, "one two three four five six", "en", "a", 1), (2, "one two three four five six", "en", "b", 1)]
    out = P.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == [(1, rows[0][1], "a"), (1, rows[1][1], "b")]


def test_last_stage_decodes(spark, odd):
    out = {r.doc_id: r for r in P.pieces(spark, odd, "").collect()}
    assert all(r.exact for r in out.values()) and out[10].n_tokens == len(out[10].token_ids) > 0
