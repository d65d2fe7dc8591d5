import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import piece_fst as S
from flowloom.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _ids(fst, texts):
    ids, size = fst.encode(pa.array(texts, pa.string()))
    assert fst.comes_back(pa.array(texts, pa.string()), ids, size) == [True] * len(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", "É", " ", "  ", "\n", "\t", "12", "...", "日本", "😀", "\x00", "er", "aaaa", "ción", " " * 17]), max_size=25))
def test_ids_are_the_librarys_and_decode_to_the_text(library, parts):
    text, fst = "".join(parts), S.machine(PATH)
    ids, size = fst.encode(pa.array([text, None, text]))
    assert ids.tolist() == library.encode(text) * 2 and size.tolist() == [len(ids) // 2, 0, len(ids) // 2]
    assert fst.decode(ids, size) == [text, "", text] and text == library.decode(ids[: size[0]].tolist())


def test_pieces_side_by_side(library):
    """Joined pieces, among them every length of blanks, meet the pair acceptor at its borders."""
    rng, pieces = random.Random(2), list(S.machine(PATH).ids)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace(S.BLANK, " ") for _ in range(4000)] + [" " * k + "x" for k in range(70)]
    assert _ids(S.machine(PATH), texts) == [library.encode(t) for t in texts]


def test_corpus(spark, corpus, library):
    docs = spark.createDataFrame([(d[0], d[1]) for d in corpus[0]], "doc_id long, text string")
    encoded = S.encode(docs, PATH)
    texts = {d[0]: d[1] for d in corpus[0]}
    assert all(r.token_ids == library.encode(texts[r.doc_id]) for r in encoded.collect())
    assert {r.doc_id: r.text for r in S.decode(encoded, PATH).collect()} == texts
    assert S.round_trip(docs, PATH).where("not exact").count() == 0


def test_odd_rows(spark, odd):
    rows = S.round_trip(odd, PATH).collect()
    assert len(rows) == odd.count() and all(r.exact for r in rows)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2, 11))
    assert S.encode(odd.limit(0), PATH).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert [r.text for r in S.decode(empty, PATH).orderBy("doc_id").collect()] == ["", ""]


def test_part_cache_may_start_anew(monkeypatch, library):
    monkeypatch.setattr(S, "CACHE_PARTS", 2)
    fst = S.PieceTransducer(PATH)
    for text in ("many different words are in this text", "and they are all encoded in this text"):
        assert _ids(fst, [text]) == [library.encode(text)]


def _model(tmp_path, pieces, kind="UNIGRAM", squeeze=True, rule=None, with_bytes=True):
    """A model file written by hand: (piece, score) besides the unknown one and the bytes; and the library that reads it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = getattr(model.trainer_spec, kind)
    model.trainer_spec.byte_fallback = with_bytes
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, True
    if rule:
        model.normalizer_spec.precompiled_charsmap = rule
    listed = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 if with_bytes else 0)] + [(p, s, 1) for p, s in pieces]
    for piece, score, type_ in listed:
        model.pieces.add(piece=piece, score=score, type=type_)
    path = str(tmp_path / "hand.model")
    open(path, "wb").write(model.SerializeToString())
    return S.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)


UNIGRAM = [("▁", -3.0), ("a", -2.5), ("b", -2.7), ("c", -2.9), ("ab", -3.1), ("bc", -3.3), ("abc", -4.6), ("▁a", -3.4), ("▁ab", -4.4), ("ca", -4.13), ("cb", -4.37)]  # no two ways of equal weight: single precision would decide


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_models_take_the_shortest_path(tmp_path, with_bytes):
    fst, library = _model(tmp_path, UNIGRAM, with_bytes=with_bytes)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabbcc  éz") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    ids, size = fst.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [library.encode(t) for t in texts]


def test_character_map_is_compiled(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    try:
        made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    except (AttributeError, RuntimeError, OSError):
        pytest.skip("the library has no ready-made rules")
    rule = sentencepiece_model_pb2.ModelProto()
    rule.ParseFromString(made)
    fst, library = _model(tmp_path, UNIGRAM, rule=rule.normalizer_spec.precompiled_charsmap)
    assert len(fst.normaliser.rules) > 1000
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "ﬁ", "Å", "é", "é", "　", "①", "\t", "\n", " ", "  ", "ｱ", "が", "​", "ab", "가"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    ids, size = fst.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [library.encode(t) for t in texts]


def test_a_part_without_a_path_is_an_error(tmp_path):
    fst, _ = _model(tmp_path, [("▁", -1.0), ("a", -2.0), ("ab", -3.0), ("abc", -4.0)], kind="BPE", with_bytes=False)
    fst.acceptor.judge = lambda left, right: np.zeros(len(left), bool)
    with pytest.raises(ValueError, match="no path"):
        fst.encode(pa.array(["a a"]))
