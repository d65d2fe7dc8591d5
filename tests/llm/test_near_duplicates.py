import random

import numpy as np
from brute_force import components_of, likeness_of, shingles_of

from flowloom.llm import probminhash as M
from flowloom.llm.common import WordHashes, hash_words, words


def _sets(texts):
    cache = WordHashes()
    return [M.shingles(hash_words(words(t), cache)) for t in texts]


def test_registers_estimate_probability_jaccard():
    rng = random.Random(1)
    for _ in range(5):
        x = [f"w{k}" for k in range(200)]
        y = x[:]
        for k in rng.sample(range(200), 6):
            y[k] = f"z{k}"
        a, b = _sets([" ".join(x), " ".join(y)])
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        s = M.signatures([a, b])
        assert abs((s[0] == s[1]).mean() - true) < 0.13


def test_registers_estimate_weighted_similarity():
    text = [f"w{k}" for k in range(400)]
    for more in (text + text[100:300], text + text[100:300] * 50, text[:300] + ["x"] * 900):
        s = M.signatures(_sets([" ".join(text), " ".join(more)]), registers=4000)
        assert abs((s[0] == s[1]).mean() - M.similarity(" ".join(text), " ".join(more))) < 0.03


def test_same_text_same_signature_whatever_the_batch():
    sets = _sets(["a b c d e f g", "q", "", "a b c d e f g"])
    s, alone = M.signatures(sets), M.signatures(sets[:1])
    assert (s[0] == s[3]).all() and (s[0] == alone[0]).all() and (s[2] == 0).all()


def test_classes_match_brute_force(spark, corpus):
    docs = corpus[0]
    rng = random.Random(2)
    base = docs[3][1].split(" ")
    more = []
    for k in range(40):  # a family whose members are alike to various degrees
        w = base[:]
        for _ in range(k % 8):
            w[rng.randrange(len(w))] = f"v{k}"
        more.append((1000 + k, " ".join(w)))
    rows = [(d[0], d[1]) for d in docs] + more
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)


def test_repeated_passages_match_brute_force(spark):
    """A passage that is repeated weighs more; a text that is repeated as a whole is the same text."""
    rng, rows = random.Random(3), []
    for k in range(25):
        text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        more = [text * 3, text + text[100:130], text + text[100:300] * 50, text + [f"n{rng.randrange(10**6)}" for _ in range(70)] * 20, text[:200] * 2 + text[200:]][k % 5]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(more))]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows) and {k % 5 for k in range(25) if got[2 * k + 1] == 2 * k} == {0, 1, 4}


def test_similarity_is_that_of_its_definition():
    rng = random.Random(5)
    for _ in range(60):
        made = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 5, 9, 40, 300]))) for _ in range(2)]
        assert abs(M.similarity(*made) - likeness_of(*map(shingles_of, made))) < 1e-9
    assert M.similarity("a b", "A, b") == 1.0 and M.similarity(None, "a") == 0.0


def test_odd_rows(spark, odd):
    got = {r.doc_id: (r.class_id, r.n_links) for r in M.near_duplicates(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    assert got[6][0] == 5 and got[8][0] == 7 and all(got[k][0] == k for k in (1, 2, 3, 4, 9, 10, 11))


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    from flowloom.llm.common import shared_dir

    got = {r.node: r.component for r in M.components(edges, shared_dir(spark)).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100


def test_small_blocks_find_the_same_classes(spark, monkeypatch):
    """A family of which many pairs are just too different: blocks of a few members and bytes give the classes of all pairs."""
    rng, rows = random.Random(9), []
    base = [f"w{k}" for k in range(120)]
    for k in range(90):
        w = base[:]
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"v{k}"
        rows.append((k, " ".join(w)))
    frame, want = spark.createDataFrame(rows, "doc_id long, text string"), components_of(rows)
    for block, size in ((4, 1 << 20), (512, 4_000)):
        monkeypatch.setattr(M, "BLOCK", block)
        monkeypatch.setattr(M, "BLOCK_BYTES", size)
        assert {r.doc_id: r.class_id for r in M.near_duplicates(frame).collect()} == want
    assert len(set(want.values())) > 5
