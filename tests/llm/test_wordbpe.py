"""Ids and decoded texts against the library on whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from furrow.llm import wordbpe
from furrow.llm.queries import QUERIES

TEXTS = [
    None, "", " \n", "Don't STOP'S I'LL it's<|endoftext|>now <|startoftext|> x<|endoftext|><|endoftext|>", "1234567 x²½ <|endoftext| > <|",
    "ñandú É é x y ▁ß İ ΑΣ \U0001f600 日本語テキスト 한국어 \x00\x1c a\x85b", "a" * 5000 + "!" * 400, "́ abc é", "xʼs 'sS's ''ll'",
    "\x00", "\x00 a \x00\x00 b", "a\xa0b　c", "word", "word", "WORD wOrd",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordbpe.default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return wordbpe.WordBpe(wordbpe.default_tokenizer())


def encoded(encoder, texts: list[str]) -> list[list[int]]:
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, count = encoder(data, np.cumsum([0, *map(len, raw)]))
    ends = np.append(0, count.cumsum())
    return [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("abETS '’s1\x00\t<|>", max_size=60), st.sampled_from(["<|endoftext|>", "<|startoftext|>x"])), max_size=6))
def test_ids_are_the_library_s(encoder, library, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_fragments_merge_alone(encoder, library):
    """Merging a whole word gives what its fragments give, long ones too."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 30, 64, 65, 300):
        for _ in range(20):
            word = "".join(chr(97 + c) for c in rng.integers(0, 26, size))
            symbols, _ = encoder.symbols([word], True)
            ids, _ = encoder.encode_pieces([word])
            assert encoder.merged_long(symbols.tolist()) == ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_forced_boundaries_are_certain(encoder):
    """No token holds the neighbours of a cut, and some words are cut."""
    symbols, _ = encoder.symbols(["qxzjvk"], True)
    assert not encoder.held[symbols[:-1], symbols[1:]].all()
    for token in list(encoder.tokens.values())[:20_000:7]:
        name = token.decode()
        if name.endswith("</w>") and not name.startswith("<|"):
            part, _ = encoder.symbols([name.removesuffix("</w>")], True)
            assert encoder.held[part[:-1], part[1:]].all()


def test_query_against_the_library(spark, tmp_path, docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    rows += [(100 + r.doc_id, r.text) for r in docs.limit(200).collect()]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))))
    out = QUERIES["op13_word_bpe"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_remembered_pieces_are_bounded(library):
    encoder = wordbpe.WordBpe(wordbpe.default_tokenizer())
    encoder.REMEMBER = 5
    for texts in (["one two three four five six seven"], ["one eight nine"], ["ten two <|endoftext|>three"]):
        assert encoded(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_any_ids(spark):
    rows = spark.createDataFrame([(1, [49406, 320, 99999, -4, 320]), (2, []), (3, None)], "doc_id int, ids array<int>")
    assert [r.decoded for r in wordbpe.decode_documents(rows).orderBy("doc_id").collect()] == ["<|startoftext|> a</w> a</w>", "", None]


def test_odd_rows(odd, none):
    out = wordbpe.decode_documents(wordbpe.encode_documents(odd))
    assert out.columns == [c for c in odd.columns if c not in ("text", "ids")] + ["ids", "n_tokens", "decoded"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.decoded for r in rows if r.doc_id in (2, 3, 6)} == {""}
    assert wordbpe.digests(wordbpe.decode_documents(wordbpe.encode_documents(none)), "doc_id").collect() == []
