import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb2

from sonara.llm import sentencepieces as sps

PLAIN = sps.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def with_map(rule, prefix=True, squeeze=True):
    """The model with one of the library's compiled character maps and rules for spaces."""
    proto, rules = pb2.ModelProto(), pb2.ModelProto()
    proto.ParseFromString(PLAIN)
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
    return proto.SerializeToString()


MODELS = {"plain": PLAIN, "nmt_nfkc": with_map("nmt_nfkc"), "nfkc_cf": with_map("nfkc_cf", squeeze=False), "no prefix": with_map("nmt_nfkc", prefix=False)}
OWN = {k: sps.PieceModel(m) for k, m in MODELS.items()}
LIBRARY = {k: sentencepiece.SentencePieceProcessor(model_proto=m) for k, m in MODELS.items()}

CASES = ["", " ", "  ", "    ", "a", " a", "a ", "  a  b  ", "a\n\n b\t", "Hello world! It's 12345.", "▁", "a▁b", "▁▁ ▁", "日本語 テスト", "ﷺ ﬁne ½ ①", "é é ǅ İ ß", "👍🏽 x²³", "\x00a\x00", "​　x y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<s></s><unk><0x0A>", "�\U0010ffff", "آ", "ｶﾞｷﾞ", "   　  ", "\x1f0", "¯", " ¯ ", "\x1f", " \x1f ", "a▁ ▁", "\x1f a"]


def library_pieces(name, text):
    found = pb2_text(LIBRARY[name].encode(text, out_type="serialized_proto"))
    return [p.id for p in found.pieces], [(p.begin, p.end) for p in found.pieces]


def pb2_text(data):
    from sentencepiece import sentencepiece_pb2

    found = sentencepiece_pb2.SentencePieceText()
    found.ParseFromString(data)
    return found


def own_pieces(name, texts):
    ids, begins, begin, end = OWN[name].encode(pa.array(texts, pa.string()))
    return [(ids[a:b].tolist(), list(zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True))) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def check(name, texts):
    for text, (ids, spans) in zip(texts, own_pieces(name, texts), strict=True):
        want_ids, want_spans = library_pieces(name, text)
        assert ids == want_ids, text
        assert spans == want_spans, text
        assert OWN[name].decode(np.array([1, *ids, 2])) == LIBRARY[name].decode([1, *ids, 2]), text


@pytest.mark.parametrize("name", MODELS)
def test_equals_library(name):
    check(name, CASES)
    for text in CASES:
        check(name, [text])


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aAbethin▁1日é́ﬁ　ガ"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_equals_library_on_any_texts(name, texts):
    check(name, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 270)), max_size=30))
def test_decode_equals_library_on_any_ids(ids):
    for name in ("plain", "nmt_nfkc", "no prefix"):
        assert OWN[name].decode(np.array(ids, dtype=np.int64)) == LIBRARY[name].decode(ids)


def test_longest_rule_of_the_map_wins():
    characters = OWN["nmt_nfkc"].map
    for text, length, out in (("éx", 3, "é"), ("ex", 0, ""), ("ﬁ", 3, "fi"), ("ガ", 3, "ガ"), ("ｶﾞ", 6, "ガ"), ("ｶ", 3, "カ")):
        data = text.encode()
        got, value = characters.longest(data, 0, len(data))
        assert (got, value.decode()) in ((length, out), (0, ""))
        assert got == length or text == "ガ"


def test_known_chunks_are_forgotten_without_effect():
    small = sps.PieceModel(PLAIN)
    small.known.most = 3
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick dog", "over and over"]
    for t in texts * 2:
        assert small.encode(pa.array([t]))[0].tolist() == LIBRARY["plain"].encode(t)


def test_other_models_are_refused():
    proto = pb2.ModelProto()
    proto.ParseFromString(PLAIN)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    with pytest.raises(ValueError, match="byte fallback"):
        sps.PieceModel(proto.SerializeToString())
    proto.ParseFromString(PLAIN)
    proto.pieces[300].type = sps.USER_DEFINED
    with pytest.raises(ValueError, match="user-defined"):
        sps.PieceModel(proto.SerializeToString())


def test_odd_rows(odd, odd_rows):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    library = LIBRARY["plain"]
    want = []
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        spans = np.array(library_pieces("plain", r[1] or "")[1], dtype="<i4")
        want.append((str(r[0]), len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids).encode()), sha(spans.tobytes()), True))
    assert sorted((str(r.doc_id), *r[1:]) for r in sps.piece_round_trip(odd, PLAIN).collect()) == sorted(want)


def test_spans_of_odd_rows_and_the_way_back(odd, odd_rows):
    made = sps.piece_encode(odd, PLAIN)
    assert sorted((str(r.doc_id), tuple(r.ids), tuple(zip(r.begins, r.ends, strict=True))) for r in made.collect()) == sorted((str(r[0]), *map(tuple, library_pieces("plain", r[1] or ""))) for r in odd_rows)
    assert sorted(r.text for r in sps.piece_decode(made, PLAIN).collect()) == sorted(r[1] or "" for r in odd_rows)


def test_odd_lists_of_ids_and_empty_tables(spark, empty):
    rows = spark.createDataFrame([(1, None), (None, []), (2, [None, 1, -7, 99999, 2])], "doc_id bigint, ids array<int>")
    assert [r.text for r in sps.piece_decode(rows, PLAIN).collect()] == ["", "", ""]
    assert sps.piece_round_trip(empty, PLAIN).count() == 0 and sps.piece_encode(empty, PLAIN).count() == 0
