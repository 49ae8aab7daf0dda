import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sonara.llm import bpe, tokens


@pytest.fixture(scope="module")
def library(tokenizer_json):
    t = Tokenizer.from_str(tokenizer_json)
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def own(tokenizer_json):
    return bpe.Encoder(tokenizer_json)


CASES = ["", " ", "  ", "a  b", "a \n b\n\nc", " x", "x ", "tab\there", "it's 's 'S don't'll", "<|endoftext|>a<|endoftext|><|endoftext|> b", "\x1cfoo\x1d bar", "日本語 テスト", "👍🏽 x²³ Ⅷ ½", "aaaaaaaaaaaaaaaa aaaa", "\r\n\r\n a", "a\x85b", "\x00\x01 \x00", "x\n", "\n", "\n\nx y"]


@pytest.mark.parametrize("text", CASES)
def test_bpe_equals_library(own, library, text):
    ids = np.frombuffer(own.encode([text])[0], dtype="<u4").tolist()
    assert ids == library[0](text)
    assert own.vocabulary.decode(np.array(ids, dtype="<u4")) == library[1](ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aAbé1日<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_equals_library_on_any_text(own, library, text):
    assert np.frombuffer(own.encode([text])[0], dtype="<u4").tolist() == library[0](text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_decode_equals_library_on_any_ids(own, library, ids):
    assert own.vocabulary.decode(np.array(ids, dtype="<u4")) == library[1](ids)


def test_known_pieces_are_forgotten_without_effect(tokenizer_json, own):
    small = bpe.Encoder(tokenizer_json)
    small.words.most = small.table.known.most = 3
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick dog", "over and over"]
    for t in texts * 2:
        assert small.encode([t]) == own.encode([t])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=600), st.integers(2, 6))
def test_repair_round_trip_and_random_access(ids, least):
    array = np.array(ids, dtype="<u4")
    base, left, right, seq = tokens.repair(array, least=least, gain=0)
    lengths = tokens.expansion_lengths(base, left, right)
    head = np.array([base, len(left), len(seq), 1], dtype="<u8").tobytes()
    shard = tokens.TokenShard(b"".join([tokens.MAGIC, head, *(np.asarray(x, dtype="<u4").tobytes() for x in (left, right, lengths, seq, [len(ids)]))]))
    assert len(shard) == len(ids) and (shard.tokens(0, len(ids)) == array).all()
    for a in range(0, len(ids), 37):
        assert (shard.tokens(a, a + 11) == array[a : a + 11]).all()
    assert (shard.document(0) == array).all()


def test_repair_shortens_repeats():
    ids = np.array([7, 8, 9, 7, 8, 9, 1] * 200, dtype="<u4")
    _, left, _, seq = tokens.repair(ids)
    assert len(seq) < len(ids) / 20 and len(left) > 3


def test_shards_of_odd_rows(spark, odd, odd_rows, library, tokenizer_json, tmp_path):
    path = f"file://{tmp_path}/shards"
    tokens.write_shards(odd, tokenizer_json, path, shard_tokens=50)
    import pyarrow as pa

    found = tokens.read_shards(odd, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "crc", pa.int64(), "bigint").orderBy("start").collect()
    want = sorted((r[0] is not None, r[0] or 0, len(ids := [*library[0](r[1] or ""), 0]), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for r in odd_rows)
    assert [r.doc_id for r in found] == [w[1] if w[0] else None for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.crc) for r in found) == want
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:k]) for k in range(len(found))]


def test_round_trip_of_odd_rows(odd, odd_rows, library, tokenizer_json):
    found = bpe.bpe_round_trip(odd, tokenizer_json).collect()
    assert all(r.same_text for r in found)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == sorted((r[0] or 0, len(library[0](r[1] or ""))) for r in odd_rows)


def test_encode_then_decode(odd, odd_rows, tokenizer_json):
    back = bpe.bpe_decode(bpe.bpe_encode(odd, tokenizer_json), tokenizer_json).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in odd_rows)


def test_empty_tables(empty, tokenizer_json):
    assert tokens.token_digest(empty, tokenizer_json).count() == 0
    assert bpe.bpe_round_trip(empty, tokenizer_json).count() == 0


def test_repair_goes_on_after_a_round_of_equal_ids():
    other = iter(range(1000, 200_000))
    ids = [x for _ in range(400) for x in (0, 0, next(other))] + [x for _ in range(100) for k in range(300) for x in (1 + k, 301 + k, next(other))]
    array = np.array(ids, dtype=np.uint32)
    base, left, right, seq = tokens.repair(array)
    assert left[0] == right[0] == 0 and len(seq) < 0.7 * len(ids)
    assert int(tokens.expansion_lengths(base, left, right)[seq[seq >= base] - base].sum()) + int((seq < base).sum()) == len(ids)
