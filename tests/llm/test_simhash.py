from __future__ import annotations

import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from furrow.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest reachable position, over distinct values."""
    order = sorted(set(fps))
    value = np.array(order, np.uint64)
    root = list(range(len(order)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(order)):
        for j in np.flatnonzero(np.bitwise_count(value[i + 1 :] ^ value[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {v: find(i) for i, v in enumerate(order)}


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    least = {}
    for (i, _), fp in zip(rows, fps):
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    return sorted(((i, f"{fp:016x}", least.get(root[fp])) for (i, _), fp in zip(rows, fps)), key=str)


def test_matches_brute_force(docs, odd):
    for df in (docs, odd):
        got = simhash.with_fingerprint_text(simhash.near_duplicates(df)).collect()
        assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in df.collect()])


def clustered(rng, n, centres, most):
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    fps = base[rng.integers(0, centres, n)]
    for _ in range(most):
        flip = rng.random(n) < 0.7
        fps = np.where(flip, fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), fps)
    return np.unique(fps)


@pytest.mark.parametrize("limit", [2, 8, 1024])
def test_links_lose_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    fps = clustered(np.random.default_rng(limit), 700, 60, 4)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = simhash.components(simhash.links(df)).collect()
    root = brute_components(fps.tolist())
    groups = {}
    for value, r in root.items():
        groups.setdefault(r, set()).add(value)
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(int(np.array([r.node]).view(np.uint64)[0]))
    assert sorted(sorted(g) for g in got.values()) == want


def test_every_close_pair_meets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        bits = rng.choice(64, rng.integers(0, 5), replace=False)
        b = a
        for bit in bits:
            b ^= np.uint64(1) << np.uint64(bit)
        for variants in (simhash.masked_variants, simhash.whole_variants):
            assert np.intersect1d(variants(np.array([a]))[0], variants(np.array([b]))[0]).size


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    found = simhash.components(edges)
    assert {r.root for r in found.collect()} == {0} and found.count() == 301


def test_keep_one_keeps_the_smallest_id_of_each_component(docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = {}
        for i, _, component in brute(rows):
            want.setdefault(component, i)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        got = sorted((r.doc_id for r in kept.collect()), key=str)
        by_root = brute_components([brute_fingerprint(t) for _, t in rows])
        assert len(got) == len(set(by_root.values()))
        assert {i for i in got if i is not None} == {c for c in want if c is not None}


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
