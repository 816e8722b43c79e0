"""Runs against brute force, planted texts against the rule, odd rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from furrow.llm import periods
from furrow.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"


def word_list(text: str | None) -> list[str]:
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def brute(words: list, least: int) -> list[tuple[int, int, int]]:
    """Runs by the definition: for every period, stretches of equal words that far apart."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            # A stretch met with a smaller period has that one as its smallest.
            if i > start and length >= 2 * q and (start, length) not in seen:
                seen.add((start, length))
                if length >= least:
                    out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs) -> str:
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50), st.sampled_from([1, 2, 3, 5, 12]))
def test_runs_of_numbers(ids, least):
    assert [tuple(r) for r in periods.runs_of(ids, least).tolist()] == brute(ids, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é"]), max_size=40), max_size=5), st.sampled_from([2, 3, 12]))
def test_pieces_lose_no_run(texts, least):
    raw = [("  ".join(t) + "\n").encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    owner, rows, places, first = periods.find(data, offsets, least)
    out, at = periods.collapse(data, owner, rows, places, first)
    for i, text in enumerate(texts):
        expected = brute(text, least)
        assert [tuple(r) for r in rows[owner == i].tolist()] == expected
        assert out[at[i] : at[i + 1]].tobytes().decode() == collapsed(text, expected)


@pytest.mark.parametrize("ids", [[1] * 30_000, [*range(1, 5_001)] * 4, [1, 2] * 9_000 + [3] + [1, 2] * 9_000])
def test_long_lists(ids):
    found = periods.runs_of(ids)
    assert len(found) and (found[:, 1] >= 2 * found[:, 2]).all()
    assert int(found[:, 1].max()) >= len(ids) // 2


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(3)
    for _ in range(40):
        ids = rng.integers(1, 4, rng.integers(1, 60)).tolist()
        text = [*ids, 0]
        leaves, turns = periods.SuffixTree(text, 4).tour()
        assert leaves.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        opposite, _ = periods.SuffixTree(text, 4).tour(upwards=False)
        assert opposite.tolist() == sorted(range(len(text)), key=lambda i: [-x if x else -9 for x in text[i:]])
        common = periods.Extensions(leaves, turns)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(text)), np.arange(len(text))))
        a, b = a[a != b], b[a != b]
        for i, j, n in zip(a.tolist(), b.tolist(), common(a, b).tolist()):
            assert text[i : i + n] == text[j : j + n] and text[i + n : i + n + 1] != text[j + n : j + n + 1]


def expected_row(doc_id, text) -> tuple:
    words, n = word_list(text), len(word_list(text))
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *digest)


def test_query_against_brute_force(spark, tmp_path, docs):
    # Short texts, so that brute force ends; the planted rule takes one document in ten.
    rows = [(r.doc_id, " ".join(word_list(r.text)[:150])) for r in docs.limit(60).collect()]
    rows += [(1000 + i, f"x{i % 3} " * 20 + "tail\n" + "p q r " * (i % 7)) for i in range(80)] + [(None, "a " * 30), (5, None), (5, ""), (6, " \t\x0b "), (6, " \t\x0b ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periods"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected_row(*r) for r in rows), key=repr)


def test_odd_rows(odd, none):
    out = periods.with_runs(odd)
    assert out.columns == [c for c in odd.columns if c != "text"] + ["runs", "collapsed"]
    rows = {(r.doc_id, r.lang): r for r in out.collect()}
    assert out.count() == odd.count()
    assert rows[2, None].runs == [] and rows[2, None].collapsed == ""
    assert rows[6, "fr"].collapsed == "" and rows[3, "en"].collapsed == ""
    long = rows[4, "en"]
    assert [tuple(r) for r in long.runs] == [(0, 80_000, 4)] and long.collapsed == "alpha beta gamma delta"
    assert periods.digests(periods.with_runs(none), "doc_id").collect() == []


def test_awkward_names(spark):
    rows = spark.createDataFrame([(1, "a " * 12, "k", 2)], "`c1` int, text string, `a b` string, runs int")
    out = periods.with_runs(rows).first()
    assert out["a b"] == "k" and out["c1"] == 1 and tuple(out["runs"][0]) == (0, 12, 1) and out["collapsed"] == "a"
    assert periods.with_runs(rows.select(F.col("a b").alias("t"), "text"), least=20).first()["runs"] == []
