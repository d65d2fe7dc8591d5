import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import tokenout as T
from flowloom.llm.common import shared_dir
from flowloom.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return T.WordwiseEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "É", "word", " ", "  ", "\n", "\t", "\x1c", " ", "'s", "!?", "7", "日", "<|endoftext|>", "&&& "]), max_size=25))
def test_wordwise_encoding_is_the_librarys(encoder, parts):
    text = "".join(parts)
    ids, size = encoder.encode(pa.array([text, None, text]), end=7)
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*want, 7, 7, *want, 7] and size.tolist() == [len(want) + 1, 1, len(want) + 1]


def test_words_may_be_forgotten(encoder, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 1)
    for text in ("many words are met, again and again", "again & again: " + "x" * 300, "many words!"):
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_rows_of_one_id_fill_several_parts(spark):
    frame = spark.range(2000).selectExpr("if(id % 2 = 0, null, 7L) as doc_id", "concat('text ', id) as text")
    folder = shared_dir(spark)
    parts = T.write_tokens(frame, folder, PATH, end_id=2, parts=6)
    assert len(parts) > 3 and max(p[2] for p in parts) < 1000
    rows = T.read_tokens(spark, folder, parts).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 1000 + [7] * 1000


def _expected(encoder, rows):
    out, start = [], 0
    for i, text in rows:
        ids = [*encoder.library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_all_ids(spark, corpus, encoder):
    rows = [(d[0], d[1]) for d in corpus[0]]
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = shared_dir(spark)
    parts = T.write_tokens(frame, folder, PATH, end_id=2)
    assert sorted(tuple(r) for r in T.read_tokens(spark, folder, parts).collect()) == _expected(encoder, sorted(rows))


def test_sequences_and_masks(spark, corpus, encoder):
    frame = spark.createDataFrame([(d[0], d[1]) for d in corpus[0]], "doc_id long, text string")
    folder = shared_dir(spark)
    for number, total, n_docs in T.write_tokens(frame, folder, PATH, end_id=2, parts=2):
        file = T.TokenFile(folder, number)
        assert len(file) == -(-total // T.SEQUENCE) and file.docs.num_rows == n_docs
        ids = np.concatenate([file.sequence(k)[file.mask(k)] for k in range(len(file))])
        assert len(ids) == total and (ids == file.ids(0, total)).all() and ids.dtype == np.uint16
        assert all(len(file.sequence(k)) == T.SEQUENCE and file.mask(k).all() for k in range(len(file) - 1))


def test_odd_rows(spark, odd, encoder):
    folder = shared_dir(spark)
    rows = sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = T.read_tokens(spark, folder, T.write_tokens(odd, folder, PATH, end_id=2)).orderBy("start").collect()
    assert [tuple(r) for r in got] == _expected(encoder, rows)


def test_empty_table(spark):
    folder = shared_dir(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_tokens(spark, folder, T.write_tokens(empty, folder, PATH, 2)).agg(F.count("*")).first()[0] == 0
