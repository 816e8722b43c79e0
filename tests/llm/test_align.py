"""Groups, links and counts against the definition, on whole texts by the libraries."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import align
from furrow.llm.queries import QUERIES
from furrow.session import checkpointed

TEXTS = [
    None, "", " ", "   ", " \n\n  x  ", "Don't <|endoftext|>now <s>x</s> <unk><0x41> a", "ñandú ▁ É", "x▁y",
    "\U0001f600 日本語テキスト 한국어 \x00\x1c a\x85b \xa0 　 z", "a" * 3000, "=-" * 900, "日本語テキスト" * 50, "tab\tx \r\n  end  ",
    "the the the", "the the the", "of the", "trail ", "trail  ",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(align.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=align.default_model())


def groups_of(text, libraries) -> list[tuple[list[int], list[int]]]:
    """By the definition: cut wherever tokens of both sides end."""
    if not text:
        return []
    tokenizer, model = libraries
    byte, piece = align.ByteEncoder(align.default_tokenizer()).spelled, align.PieceEncoder(align.default_model()).spelled
    a, b, full = tokenizer.encode(f" {text}", add_special_tokens=False).ids, model.encode(text), f" {text}".encode()
    if b"".join(byte[i] for i in a) != full or b"".join(piece[i] for i in b) != full:
        return []
    ends_a, ends_b = (dict(zip(np.cumsum([len(t[i]) for i in ids]).tolist(), range(1, len(ids) + 1))) for t, ids in ((byte, a), (piece, b)))
    out, at_a, at_b = [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        out.append((a[at_a : ends_a[end]], b[at_b : ends_b[end]]))
        at_a, at_b = ends_a[end], ends_b[end]
    return out


def brute(rows, libraries) -> list[tuple]:
    every = [(i, groups_of(text, libraries)) for i, text in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in every]
    count, best = Counter(p for each in links for p in each), defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, groups), each in zip(every, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(each.values()), digest,
            sum(n for p, n in each.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in each.items()),
        ))
    return out


def test_query_against_brute_force(spark, tmp_path, docs, libraries, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 4000)  # many blocks
    monkeypatch.setattr(align, "CHUNK_BYTES", 1500)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "of the"), (3, "again"), (3, "again")]
    rows += [(100 + r.doc_id, r.text) for r in docs.limit(25).collect()]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_alignment"](spark, str(tmp_path))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert out.columns == names
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute(rows, libraries), key=repr)


def test_cuts_of_random_ends():
    rng = np.random.default_rng(5)
    for _ in range(300):
        ends, first = [[], []], [[0], [0]]
        at = 0
        for _ in range(rng.integers(1, 4)):
            size = int(rng.integers(0, 40))
            for side in range(2 if size else 0):
                inner = np.flatnonzero(rng.random(size - 1) < rng.random()) + 1
                ends[side] += [at + e for e in [*inner.tolist(), size]]
            for side in range(2):
                first[side].append(len(ends[side]))
            at += size
        a, b = (np.array(e, np.int64) for e in ends)
        cut_a, cut_b = align.common_cuts(a, b, np.array(first[0]), np.array(first[1]))
        both = sorted({*a.tolist()} & {*b.tolist()})
        assert a[cut_a].tolist() == both and b[cut_b].tolist() == both


def test_large_groups_are_counted_first():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 5, 200)
    at_a, at_b, text = np.array([0, 2, 300]), np.array([0, 199, 200]), np.array([0, 4])
    want = Counter()
    for g in range(2):
        for x in a[at_a[g] : at_a[g + 1]].tolist():
            for y in b[at_b[g] : at_b[g + 1]].tolist():
                want[int(text[g]) * 50 + x * 5 + y] += 1
    for limit in (1, 1 << 20):
        old, align.PAIRED = align.PAIRED, limit
        key, times = align.linked_pairs(a, b, at_a, at_b, text, 5, 50)
        align.PAIRED = old
        assert dict(zip(key.tolist(), times.tolist())) == dict(want) and (np.diff(key) > 0).all()


def test_counts_do_not_depend_on_blocks(spark, docs):
    few = docs.select("doc_id", "text").limit(40)
    whole = checkpointed(align.align(few.coalesce(1)), spark, "aligned-test")
    split = checkpointed(align.align(few.repartition(7)), spark, "aligned-test")
    counts = [sorted(map(tuple, align.pair_documents(x).collect())) for x in (whole, split)]
    assert counts[0] == counts[1] and len(counts[0]) > 500
    assert max(n for _, _, n in counts[0]) <= 40


def test_odd_rows(spark, odd, none):
    stored = checkpointed(align.align(odd), spark, "aligned-test")
    out = align.with_link_counts(stored)
    kept = [c for c in odd.columns if c != "text"]
    assert out.columns == [*kept, *dict(align.RESULT), "n_best", "count_sum"]
    rows = out.withColumn("groups", align.parsed_groups(F.col("groups"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_groups == len(r.groups) and r.n_a == sum(len(g.a) for g in r.groups) and r.n_b == sum(len(g.b) for g in r.groups)
        assert (r.n_a == 0) == (r.count_sum == 0)
    # The word mark in the text of 7 is a space to one tokenizer.
    assert {r.doc_id for r in rows if not r.n_a} == {2, 3, 7, None}
    assert align.digests(none, "doc_id").collect() == []
