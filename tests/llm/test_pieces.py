from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from furrow.llm import pieces, words

TEXTS = [
    "", " ", "   ", "Hello world, this is  a test.\n\nNew\tline \r\n;\r done", "▁ marks ▁▁ in text", "ñandú élève größe 東京 \U0001f600\U0001f600",
    "a", "\n", "x" * 300, "\x00\x01 control", "trailing space ", " leading", None, "ab" * 2000 + " " * 70 + "end", "ﬁ ligature   nbsp",
]


@pytest.fixture(scope="module")
def table():
    return pieces.Pieces.load(pieces.default_model())


def run(table, texts, variants=None, **how):
    data, offsets = words.flat(pa.array(texts, pa.string()))
    ids, count = pieces.encode(table, data, offsets, np.zeros(len(texts), np.int64) if variants is None else np.array(variants), **how)
    ends = count.cumsum()
    return [ids[e - c : e].tolist() for e, c in zip(ends, count)]


def test_without_dropout_it_is_the_library(table, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [t for t in TEXTS if t and "▁" not in t] + [r.text for r in docs.collect()]
    assert run(table, texts, rate=0.0) == [model.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_text_comes_back(table, docs, rate):
    texts = TEXTS + [r.text for r in docs.limit(50).collect()]
    data, offsets = words.flat(pa.array(texts, pa.string()))
    ids, count = pieces.encode(table, data, offsets, np.arange(len(texts)) % 5, rate=rate)
    back, places = pieces.decode(table, ids, count)
    assert [back[a:b].decode() for a, b in zip(places, places[1:])] == [t or "" for t in texts]


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_steps_and_agenda_agree(table, rate):
    rng = np.random.default_rng(3)
    letters = np.array([table.of_char[ord(c)] for c in "theandorigs"] + [-1 - 0x4E00])
    for n in (1, 2, 3, 7, 20, 64):
        symbols = letters[rng.integers(0, len(letters), (200, n))]
        keys = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        merged, left = pieces.merge_in_step(table, symbols, keys, rate)
        for i in range(200):
            assert merged[i, : left[i]].tolist() == pieces.merge_heap(table, symbols[i], int(keys[i]), rate).tolist()


def brute(table, symbols, key, rate):
    """Rescan all neighbours after every merge."""
    sym, edge = symbols.tolist(), list(range(len(symbols) + 1))
    while True:
        best = None
        for i in range(len(sym) - 1):
            rank = int(table.ranks(np.array([sym[i]]), np.array([sym[i + 1]]))[0])
            skip = pieces._skipped(np.array([key], np.uint64), np.array([edge[i]]), np.array([edge[i + 1]]), np.array([edge[i + 2]]), rate)[0]
            if rank < pieces.NONE and not skip and (best is None or rank < best[0]):
                best = (rank, i)
        if best is None:
            return sym
        i = best[1]
        sym[i : i + 2] = [int(table.joins(np.array([sym[i]]), np.array([sym[i + 1]]))[0])]
        del edge[i + 1]


def test_agenda_matches_rescanning(table):
    for n, text in enumerate(["▁international", "▁thththereinganderonthe", "▁▁▁▁▁a", "▁Kraftfahrzeughaftpflicht", "▁ciónmente"]):
        symbols = np.array([table.of_char[32 if c == "▁" else ord(c)] for c in text])
        for rate in (0.0, 0.2, 0.6):
            assert pieces.merge_heap(table, symbols, n * 7919, rate).tolist() == brute(table, symbols, n * 7919, rate)


def test_same_key_same_pieces_other_keys_vary(table):
    text = ["understanding international representation " * 5]
    one = run(table, text, [1], rate=0.3)
    assert one == run(table, text, [1], rate=0.3)
    assert len({tuple(run(table, text, [v], rate=0.3)[0]) for v in range(6)}) > 3
    assert run(table, text, [1], rate=0.3, seed=5) != one


def test_documents(odd, none, docs):
    got = pieces.encode_documents(odd).toPandas()
    assert len(got) == odd.count() and got.lossless.all() and "score" in got
    assert got[got.doc_id == 2].ids.isna().all() and (got[got.doc_id == 3].n_pieces == 0).all()
    whole = pieces.encode_documents(docs).toPandas()
    assert len(whole) == docs.count() and whole.lossless.all() and (whole.ids.map(len) == whole.n_pieces).all()
    assert pieces.encode_documents(none).count() == 0
