from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from furrow.llm import tokens, words


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return tokens.TextEncoder(tokens.default_tokenizer())


def encoded(encoder, texts):
    ids, count = encoder(*words.flat(pa.array(texts, pa.string())))
    ends = count.cumsum()
    return [ids[e - c : e].tolist() for e, c in zip(ends, count)]


ODD = ["", " ", "  a  b ", "don't we'll I'm", "a  b  c　 d", "x \n y\r\n z", "123 45,6 <|endoftext|> ñ é\U0001f600", None, " lead", "trail ", "a " * 500, "\x1f \x85   x"]


def test_parts_are_tokenized_like_whole_texts(tokenizer, encoder, docs):
    texts = ODD + [r.text for r in docs.collect()]
    assert encoded(encoder, texts) == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1'. \n\t\u00a0\u3000é,sl-\x1c", max_size=14), min_size=1, max_size=4))
def test_cutting_never_changes_tokens(tokenizer, encoder, texts):
    assert encoded(encoder, texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 2, tokens.BLOCK_IDS, tokens.BLOCK_IDS + 1, 5 * tokens.BLOCK_IDS - 3])
@pytest.mark.parametrize("kinds", [1, 3, 400, 50_000])
def test_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = (rng.integers(0, kinds, n) * rng.integers(0, 2, n)).astype(np.int64)
    ids[: n // 2] = np.resize(rng.integers(0, kinds, 17), n // 2)
    data = tokens.pack([5, None], np.array([n - n // 3, n // 3]), ids)
    head, blocks = tokens.unpack_blocks(data)
    assert np.array_equal(np.concatenate([*blocks, np.zeros(0, np.int64)]), ids)
    assert head["docs"].tolist() == [5, tokens.NO_ID] and head["lengths"].tolist() == [n - n // 3, n // 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**29 - 1) | st.integers(0, 2), max_size=300))
def test_round_trip_of_any_ids(ids):
    data = tokens.pack([1], np.array([len(ids)]), np.array(ids, np.int64))
    assert np.concatenate([*tokens.unpack_blocks(data)[1], np.zeros(0, np.int64)]).tolist() == ids


def test_blocks_are_read_alone_and_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 900, 6 * tokens.BLOCK_IDS)
    data = tokens.pack([1], np.array([len(ids)]), ids)
    _, (only,) = tokens.unpack_blocks(data, [3])
    assert np.array_equal(only, ids[3 * tokens.BLOCK_IDS : 4 * tokens.BLOCK_IDS])
    at = tokens.unpack_header(data)["blocks_at"]
    bad = bytearray(data)
    bad[at + 40] ^= 255
    with pytest.raises(ValueError):
        tokens.unpack_blocks(bytes(bad), [0])
    tokens.unpack_blocks(bytes(bad), [5])
    bad = bytearray(data)
    bad[30] ^= 1
    with pytest.raises(ValueError):
        tokens.unpack_blocks(bytes(bad))
    with pytest.raises(ValueError):
        tokens.unpack_blocks(data[:-200])


def test_repetition_and_skew_are_used():
    rng = np.random.default_rng(2)
    n = 20 * tokens.BLOCK_IDS
    loop = np.resize(rng.integers(0, 50_000, 60), n)
    assert len(tokens.pack([1], np.array([n]), loop)) < n * 0.3
    skewed = np.minimum(rng.geometric(0.02, n), 49_999)
    assert len(tokens.pack([1], np.array([n]), skewed)) < n * 1.05  # about 7.1 bits of entropy
    with pytest.raises(ValueError):
        tokens.pack([1], np.array([1]), np.array([-1]))


def test_few_lanes_send_at_a_step(monkeypatch):
    """16 bits leave at a time: an id of about 8 bits moves half a lane, not a whole one."""
    sent, carried = [], []
    send, carry = tokens.Encoder._send, tokens.Encoder._carry
    monkeypatch.setattr(tokens.Encoder, "_send", lambda self, lanes: (sent.append(len(lanes)), send(self, lanes)))
    monkeypatch.setattr(tokens.Encoder, "_carry", lambda self, lanes: (carried.append(len(lanes)), carry(self, lanes)))
    ids = np.minimum(np.random.default_rng(4).geometric(0.01, 64 * tokens.BLOCK_IDS), 49_999)
    data = tokens.pack([1], np.array([len(ids)]), ids)
    assert sum(sent) < 0.6 * len(ids) and sum(carried) > 0
    assert np.array_equal(np.concatenate(tokens.unpack_blocks(data)[1]), ids)


def test_narrowest_intervals_come_back():
    """Ids that are rare in their file follow long runs, so that both choices take their smallest share."""
    rng = np.random.default_rng(5)
    ids = np.full(80 * tokens.BLOCK_IDS, 7)
    at = np.flatnonzero(rng.random(len(ids)) < 0.02)
    ids[at] = 100 + np.arange(len(at))
    data = tokens.pack([1], np.array([len(ids)]), ids)
    assert np.array_equal(np.concatenate(tokens.unpack_blocks(data)[1]), ids)


def test_known_parts_are_not_encoded_again_and_the_bank_is_bounded(tokenizer, monkeypatch):
    encoder = tokens.TextEncoder(tokens.default_tokenizer())
    texts = ["one two three, four", "two " + "x" * 500 + " three", "four four one"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    given, run = [], encoder.run
    monkeypatch.setattr(encoder, "run", lambda parts: (given.extend(parts), run(parts))[1])
    assert encoded(encoder, texts) == want
    assert max(map(len, encoder.bank.parts.to_pylist())) <= encoder.SHORT and len(encoder.bank.ids) == encoder.bank.number.sum()
    given.clear()
    assert encoded(encoder, texts[::-1]) == want[::-1]
    assert given == [b" " + b"x" * 500]
    encoder.REMEMBER = len(encoder.bank.parts) + 2
    more = ["five six seven eight", "nine one"]
    assert encoded(encoder, more) == [e.ids for e in tokenizer.encode_batch(more, add_special_tokens=False)]
    assert len(encoder.bank.parts) == encoder.REMEMBER


def brute(tokenizer, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, before = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_whole_table(docs, tokenizer):
    got = sorted(map(tuple, tokens.tokenize_to_files(docs).collect()))
    assert got == brute(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, none, tokenizer, monkeypatch):
    got = sorted(tokens.tokenize_to_files(odd).collect(), key=lambda r: r.start)
    want = brute(tokenizer, [(r.doc_id, r.text) for r in odd.collect()])
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(w[0]), w[2], w[3]) for w in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert tokens.tokenize_to_files(none).count() == 0


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b c", " x  <|endoftext|>  y <|endoftext|><|endoftext|>", "<|endoftext", "|> split", "<|endoftext|", " z " * 40 + "<|endoftext|>", "plain text", None, ""]


def test_special_strings_are_tokens_as_in_the_library(spark):
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    texts = SPECIAL + ODD
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = tokens.TextEncoder(tokens.default_tokenizer(), special=True)
    assert encoded(encoder, texts) == want and encoded(encoder, texts[::-1]) == want[::-1] and 50256 in want[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, tokens.tokenize_to_files(df).collect())) == brute(plain, list(enumerate(texts)))
