import hashlib

import numpy as np
import pytest
from brute_force import contamination_of, words_of

from flowloom.llm import decontam as D


def _frames(spark, corpus):
    docs, items, _ = corpus
    return spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def _expected(corpus):
    docs, items, _ = corpus
    out = {}
    for i, text, *_ in docs:
        n, hit, found = contamination_of(text, items)
        out[i] = (n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    return out


def test_matches_brute_force(spark, corpus):
    docs, bench = _frames(spark, corpus)
    got = {r.doc_id: tuple(r)[1:] for r in D.digest(D.contamination(docs, bench)).collect()}
    assert got == _expected(corpus)
    assert sum(x[4] for x in got.values()) >= 5


def test_several_blocks_agree(spark, corpus, monkeypatch):
    docs, bench = _frames(spark, corpus)
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    got = {r.doc_id: tuple(r)[1:] for r in D.digest(D.contamination(docs, bench)).collect()}
    assert got == _expected(corpus)
    clean = {i for i, x in _expected(corpus).items() if not x[4]}
    assert {r.doc_id for r in D.decontaminate(docs, bench).collect()} == clean


@pytest.mark.parametrize("block_words", [25, 1 << 20])
def test_rows_are_judged_by_themselves(spark, corpus, monkeypatch, block_words):
    """Null and repeated ids: a clean and a contaminated row of one id go their own ways, whatever the benchmark's size."""
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    items = [(i, t) for i, t in corpus[1]]
    rows = [(None, items[0][1]), (7, items[1][1]), (7, "a clean text of some other words"), (None, "another clean one"), (8, items[2][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in D.decontaminate(docs, _frames(spark, corpus)[1]).collect()]
    assert sorted(kept, key=str) == sorted([rows[2], rows[3]], key=str)


def test_items_without_id_mark_words_and_repeated_ids_count_once(spark):
    item = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(None, item), (3, "x y z"), (3, "p q r s"), (3, "x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, "x y z p q r s")], "doc_id long, text string")
    assert [(r.doc_id, r.n_hit, r["items"], r.contaminated) for r in D.contamination(docs, bench).orderBy("doc_id").collect()] == [(1, 20, [], True), (2, 7, ["3"], True)]


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(0)
    for text in (rng.integers(1, 4, 400), np.full(300, 5), rng.integers(0, 3, 500)):
        text = np.append(text, 0).astype(np.uint64)
        array = D.SuffixArray(text.copy(), depth=1000)
        suffix = lambda p: text[p : p + array.room[p]].tolist()  # noqa: B023, E731
        assert sorted(array.at.tolist()) == np.flatnonzero(text).tolist()
        assert all(suffix(a) <= suffix(b) for a, b in zip(array.at, array.at[1:]))


def test_longest_matches(spark, corpus):
    docs, bench = _frames(spark, corpus)
    texts, items = {d[0]: words_of(d[1]) for d in corpus[0]}, {i: words_of(t) for i, t in corpus[1]}
    rows = D.longest_matches(docs, bench).collect()
    assert rows
    for r in rows:
        a, b = texts[r.doc_id], items[r.item_id]
        assert a[r.doc_word : r.doc_word + r.n_words] == b[r.item_word : r.item_word + r.n_words]
        before = r.doc_word and r.item_word and a[r.doc_word - 1] == b[r.item_word - 1]
        after = r.doc_word + r.n_words < len(a) and r.item_word + r.n_words < len(b) and a[r.doc_word + r.n_words] == b[r.item_word + r.n_words]
        assert not before and not after


def test_odd_rows(spark, odd, corpus):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "word"), (1, "one")], "item_id long, text string")
    got = [(r.doc_id, r.n_hit, r.contaminated) for r in D.contamination(odd, bench).collect()]
    assert len(got) == odd.count()
    assert all(c == (h > 0) for _, h, c in got) and sum(c for *_, c in got) == 6  # the item without an id counts too
    assert D.decontaminate(odd, bench).columns == odd.columns


def test_empty_tables(spark, corpus):
    docs, bench = _frames(spark, corpus)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_tasks_give_their_memory_back():
    """What a task has freed doesn't stay with its worker, which later stages' tasks share an executor with."""
    import os

    from flowloom.llm.common import lean

    def held() -> int:
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def run(batches):
        pieces = [bytes(50_000) for _ in range(4_000)]  # below malloc's threshold for maps of their own
        kept.append(bytes(50_000))  # keeps the heap's end in use
        yield from batches
        del pieces

    kept, before = [], held()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert held() - before < 50_000_000
