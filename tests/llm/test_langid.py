from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import langid, words


def brute(word, pieces, p):
    """Sum over every way to cut the word."""
    total = 0.0
    for cut in itertools.product([0, 1], repeat=len(word) - 1):
        parts, part = [], word[:1]
        for c, bit in zip(word[1:], cut):
            if bit:
                parts.append(part)
                part = b""
            part += bytes([c])
        parts.append(part)
        if all(x in pieces for x in parts):
            total += np.prod([p[pieces.index(x)] for x in parts])
    return total


@pytest.fixture(scope="module")
def small():
    pieces = sorted([bytes([b]) for b in range(256)] + [b"th", b"the", b" t", b" the", b"he", b"an", "é".encode(), b"  "], key=lambda x: (len(x), x))
    rng = np.random.default_rng(4)
    probs = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros(2)])
    return pieces, langid.Vocabulary.of(pieces), probs


def test_forward_sums_all_segmentations(small):
    pieces, vocabulary, probs = small
    for word in (b"the", b" thean", " é th".encode(), b"h", b"thethethe"):
        got = langid.forward(np.frombuffer(word, np.uint8)[None, :], vocabulary, probs)[0]
        assert got == pytest.approx([brute(word, pieces, probs[:, m]) for m in (0, 1)])


def test_expected_counts_match_enumeration(small):
    pieces, vocabulary, probs = small
    word = b" thean"
    got = langid.expected(np.frombuffer(word, np.uint8)[None, :], np.array([3.0]), vocabulary, probs[:, 0])
    assert (got * [len(p) for p in pieces]).sum() == pytest.approx(3 * len(word))


def test_texts_are_products_of_words(small):
    pieces, vocabulary, probs = small
    texts = ["the an", "", None, "é" * 200 + " the", " the \n the\tx"]
    got = langid.log_probabilities(*words.flat(pa.array(texts, pa.string())), vocabulary, probs)
    want = np.log([brute(b" the", pieces, probs[:, m]) * brute(b" an", pieces, probs[:, m]) for m in (0, 1)])
    assert got[0] == pytest.approx(want) and (got[1:3] == 0).all() and np.isfinite(got).all()


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(df).join(df, "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() >= 0.97


def test_odd_rows(odd, none):
    got = langid.predictions(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (2, 3, 6):
            assert r.lang_pred == "und" and r.score == 0
        if r.doc_id in (1, 4, 5, 7, 8):
            assert r.lang_pred in ("en", "de", "es", "fr")
    assert langid.predictions(none).count() == 0


def test_nothing_to_learn_from(odd):
    from pyspark.sql import functions as F

    rows = langid.predictions(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_held_out_rows_do_not_matter(docs):
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(langid.train_rows(), F.col("lang")).otherwise("xx"))
    a, b = (langid.predictions(d).orderBy("doc_id").toPandas() for d in (docs, changed))
    assert (a.lang_pred == b.lang_pred).all() and np.allclose(a.score, b.score)


def test_letters():
    assert langid.has_letter(b"1a") and langid.has_letter("é".encode()) and langid.has_letter("東".encode())
    assert not langid.has_letter(b"") and not langid.has_letter(b"12 .,") and not langid.has_letter("€ ½\U0001f600".encode())


def summed(word, pieces, p):
    """Log of the sum over every way to cut the word, place by place."""
    number = {x: i for i, x in enumerate(pieces)}
    alpha = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for n in range(1, end + 1):
            if word[end - n : end] in number:
                alpha[end] = np.logaddexp(alpha[end], alpha[end - n] + np.log(p[number[word[end - n : end]]]))
    return alpha[-1]


def test_every_piece_of_the_vocabulary_is_kept():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.default_vocabulary())
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    want = {model.id_to_piece(i).replace("\u2581", " ").encode() for i in plain}
    pieces = langid.read_pieces(langid.default_vocabulary())
    assert want <= set(pieces) and max(map(len, pieces)) > 8
    vocabulary = langid.Vocabulary.of(pieces)
    for i in [*range(0, len(pieces), 997), len(pieces) - 1]:
        found = langid._found(np.frombuffer(pieces[i], np.uint8)[None, :], vocabulary)
        assert (0, len(pieces[i]), i) in {(start, n, int(ids[0])) for start, n, _, ids in found}


def test_words_of_any_length_are_summed_whole(monkeypatch):
    """Long pieces count, also where they lie across any multiple of the length at which words are taken in stretches."""
    more = [b"the", b"he", b"straightforwardness", b" straight", b"forward", b"abab", b"ba", "\u6771\u4eac".encode()]
    pieces = sorted([bytes([b]) for b in range(256)] + more, key=lambda x: (len(x), x))
    rng = np.random.default_rng(5)
    probs = np.vstack([rng.dirichlet(np.ones(len(pieces)), 2).T, np.zeros(2)])
    texts = ["xyz" * 13 + "straightforwardness" * 4, "straightforwardness", "ab" * 150 + "the" * 40, "q" * 400, "\u6771\u4eac" * 30 + "the" * 5 + " the " + "the" * 17]
    vocabulary = langid.Vocabulary.of(pieces)
    want = [[sum(summed(b" " + w, pieces, probs[:, m]) for w in t.encode().split()) for m in (0, 1)] for t in texts]
    for cells in (langid.CELLS, 7):
        monkeypatch.setattr(langid, "CELLS", cells)
        got = langid.log_probabilities(*words.flat(pa.array(texts, pa.string())), vocabulary, probs)
        assert got == pytest.approx(np.array(want), rel=1e-9)


def test_expected_counts_of_a_very_long_word(small):
    pieces, vocabulary, probs = small
    word = b" the" + b"than" * 300
    got = langid.expected(np.frombuffer(word, np.uint8)[None, :], np.array([2.0]), vocabulary, probs[:, 0])
    assert (got * [len(p) for p in pieces]).sum() == pytest.approx(2 * len(word))
