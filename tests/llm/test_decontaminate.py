from __future__ import annotations

import re

import numpy as np
import pytest

from furrow.llm import decontaminate as dc


def split(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = int(rng.integers(0, len(words)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            words[at] = f"new{rng.integers(0, 10**6)}"
        elif kind == 1:
            words.insert(at, f"new{rng.integers(0, 10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def test_distances_match_the_plain_table():
    rng = np.random.default_rng(1)
    for n in (5, 6, 13, 30):
        k = dc.allowed_edits(n)
        a = rng.integers(0, 4, (60, n)).astype(np.uint64)
        b = a.copy()
        for i in range(60):
            line = edited(rng, a[i].tolist(), int(rng.integers(0, k + 2)))
            line = [x if not isinstance(x, str) else 9 for x in line][:n]
            b[i, : len(line)] = line
        got = dc.edit_distances(a, b, k)
        for i in range(60):
            want = distance(a[i].tolist(), b[i].tolist())
            assert (got[i] == want) if want <= k else (got[i] > k)


@pytest.mark.parametrize("n", [10, 20, 40, 60])
def test_recall_at_the_largest_distance(n):
    """The samples alone find at least nineteen of twenty windows at the limit."""
    rng = np.random.default_rng(n)
    plan, k, tries = dc.Plan(n), dc.allowed_edits(n), 300
    items = rng.integers(0, 1 << 63, (tries, n), dtype=np.uint64)
    windows = np.zeros_like(items)
    for i in range(tries):
        line = items[i].tolist()
        for _ in range(k // 2):  # an insertion and a deletion are two edits and keep the length
            line.insert(int(rng.integers(0, n)), int(rng.integers(0, 1 << 62)))
            del line[int(rng.integers(0, n + 1))]
        if k % 2:
            line[int(rng.integers(0, n))] = 7
        windows[i] = line
    hit = (plan.signatures(items) == plan.signatures(windows)).any(axis=0)
    assert hit.mean() >= 0.95
    assert (plan.signatures(items) == plan.signatures(items.copy())).all()


@pytest.mark.parametrize("n", [5, 10, 15, 30, 34, 40, 45, 60])
def test_unrelated_windows_seldom_collide(n):
    rng = np.random.default_rng(n)
    plan = dc.Plan(n)
    a, b = (plan.signatures(rng.integers(0, 1 << 63, (300, n), dtype=np.uint64)) for _ in range(2))
    assert (a == b).any(axis=0).mean() < 0.02


def test_collisions_are_expanded_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    signatures, items = rng.integers(0, 4, (6, 50), dtype=np.uint64), rng.integers(0, 4, (6, 9), dtype=np.uint64)
    marks = dc._salted(items)
    order = np.argsort(marks, kind="stable")
    want = {w * 9 + i for w in range(50) for i in range(9) if (signatures[:, w] == items[:, i]).any()}
    monkeypatch.setattr(dc, "PAIRS", 40)
    parts = list(dc._colliding(marks[order], order % 9, signatures, 9))
    assert len(parts) > 10 and sum(map(len, parts)) == len(want) and set(np.concatenate(parts).tolist()) == want


def brute(docs, items):
    named = {}
    for i, t in items:
        w = split(t)
        if i is not None and len(w) >= dc.LEAST_WORDS:
            named[tuple(w)] = min(i, named.get(tuple(w), i))
    out = set()
    for d, t in docs:
        words = split(t)
        for w, i in named.items():
            n, k = len(w), dc.allowed_edits(len(w))
            kinds = set(w)
            for s in range(len(words) - n + 1):
                if sum(x in kinds for x in words[s : s + n]) >= n - k and distance(w, words[s : s + n]) <= k:
                    out.add((d, i))
    return out


def test_whole_table(docs, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs, bench).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]) and got


def test_edited_passages(spark, monkeypatch):
    rng = np.random.default_rng(8)
    bag = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(bag, int(rng.integers(8, 50))))) for i in range(40)]
    items += [(100, items[3][1].upper() + "!"), (101, "too short"), (102, None), (None, items[4][1]), (103, "")]
    docs = []
    for i in range(400):
        words = list(rng.choice(bag, int(rng.integers(0, 120))))
        item = split(items[i % 40][1])
        words[len(words) // 2 : len(words) // 2] = edited(rng, item, int(rng.integers(0, dc.allowed_edits(len(item)) + 3)))
        docs.append((i, ", ".join(words)))
    docs += [(None, items[0][1]), (7000, None), (7001, ""), (7002, "x " * 50_000 + items[1][1]), (5, docs[5][1])]
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 16)  # several passes
    got = dc.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found, want = {(r.doc_id, r.item_id) for r in got}, brute(docs, items)
    assert found <= want and len(found) == len(got)
    assert len(found) >= 0.98 * len(want) and (7002, 1) in found and (None, 0) in found
    kept = dc.drop_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    left = {r.doc_id for r in kept.collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in found}


def test_empty_tables(odd, none, spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    assert {r.doc_id for r in dc.matches(odd, bench).collect()} == {8}
    assert dc.matches(none, bench).count() == 0 and dc.drop_leaks(none, bench).count() == 0
    assert dc.matches(odd, bench.limit(0)).count() == 0
    assert dc.drop_leaks(odd, bench).columns == odd.columns and dc.drop_leaks(odd, bench).count() == odd.count() - 1


def closest(item, words):
    """Fewest edits between the item and any window, of any length."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_windows_of_the_best_fitting_length(spark):
    """Short documents, k insertions, k deletions and random edits, against brute force over all windows."""
    rng = np.random.default_rng(11)
    bag = [f"w{i}" for i in range(900)]
    items = {i: list(rng.choice(bag, n)) for i, n in enumerate([5, 9, 20, 37, 50, 50, 60])}
    docs, sure = {}, set()
    for i, item in items.items():
        n, k = len(item), len(item) // 5
        around = [list(rng.choice(bag, 30)) for _ in range(2)]
        more, less = list(item), list(item)
        for at in sorted(rng.choice(n - 1, k, replace=False).tolist(), reverse=True):
            more.insert(at + 1, f"new{at}")
            del less[at]
        for body in (item[:-1], item[1:], less):
            sure.add((len(docs), i))
            docs[len(docs)] = body  # the whole document
        for body in (more, less, *(edited(rng, item, k) for _ in range(12)), *(edited(rng, item, k + 2) for _ in range(6))):
            docs[len(docs)] = around[0] + body + around[1]
    order = [len(docs), *docs]
    docs[len(docs)] = []
    rows = [(d, " ".join(docs[d])) for d in order]
    args = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.matches(*args, fit=True).collect()}
    want = {(d, i): e for d, w in docs.items() for i, item in items.items() if (e := closest(item, w)) <= len(item) // 5}
    assert got.keys() <= want.keys() and all(got[x] >= want[x] for x in got)
    assert len(got) >= 0.98 * len(want) and sure <= got.keys()
    fixed = {(r.doc_id, r.item_id) for r in dc.matches(*args).collect()}
    assert len(fixed) < len(got)
    assert {r.doc_id for r in dc.drop_leaks(*args, fit=True).collect()} == docs.keys() - {d for d, _ in got}


def test_the_query_and_the_pipeline_fit(spark, tmp_path):
    import corpus_pipeline
    from furrow.llm.queries import QUERIES

    item = [f"w{i}" for i in range(40)]
    more = [x for i, w in enumerate(item) for x in ([w, f"new{i}"] if i % 5 == 2 else [w])]
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, " ".join(item[:-1])), (2, " ".join(["a"] * 9 + more + ["b"] * 9)), (3, "a b c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.distance) for r in QUERIES["op1_decontamination"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 8)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()] == [3]
