from __future__ import annotations

import collections
import math
import re

import pytest

from furrow.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def check(df, got):
    rows = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    assert sorted((tuple(r[c] for c in ["doc_id", *rules.COUNTS]) for r in got), key=str) == rows


def test_counts_match_brute_force(docs, odd, labels):
    for df in (docs, odd):
        check(df, rules.verdicts(df, labels).collect())


TRICKY = ["a b c a b c", "a a a a", "x\n x\nx\nx\n\n \n \nx ", "# $ % é\U0001f600 ñ|<>&*", "a b a b a b c d e f", "\x0b\x0c a \r b", "a b c d a b e b c d", "w " * 3000 + "q r s " * 2]


def test_tricky_texts(spark, labels):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id int, text string")
    check(df, rules.verdicts(df, labels).collect())


def test_scores_match_brute_force(docs, labels):
    sample = {r.doc_id: r.label for r in rules.bounded_sample(labels).collect()}
    got = {r.doc_id: r for r in rules.verdicts(docs, labels).collect()}
    spark = docs.sparkSession
    grams = {r.doc_id: list(r.g) for r in rules.with_words(docs, "text").select("doc_id", rules.ngram_buckets().alias("g")).collect()}
    raw = collections.Counter(b for g in grams.values() for b in g)
    target = collections.Counter(b for i, g in grams.items() if sample.get(i) == 1 for b in g)
    many, trusted = sum(raw.values()), sum(target.values())
    for i, g in grams.items():
        ratio = [math.log((target[b] + 1) / (trusted + rules.BUCKETS)) - math.log((raw[b] + 1) / (many + rules.BUCKETS)) for b in g]
        assert got[i].score == pytest.approx(sum(ratio) / max(len(g), 1), abs=2e-6)
    assert spark is not None and {r.kept for r in got.values()} == {True, False}


def test_trusted_counts_do_not_stop_at_the_sample(docs, labels, monkeypatch):
    """The bound holds for the threshold alone: scores do not change with it."""
    scores = lambda: sorted((r.doc_id, r.n_words, r.score) for r in rules.verdicts(docs, labels).collect())
    want, small = scores(), rules.bounded_sample(labels, 20)
    monkeypatch.setattr(rules, "bounded_sample", lambda labels: small)
    assert small.where("label = 1").count() < rules.distinct_labels(labels).where("label = 1").count()
    assert scores() == want


def test_base_failures_are_never_kept(docs, odd, labels):
    for df in (docs, odd):
        assert not any(r.base_failed and r.kept for r in rules.verdicts(df, labels).collect())


def test_junk_goes_and_clean_text_stays(spark):
    d = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = rules.verdicts(df, labels).join(df.select("doc_id", "text"), "doc_id").where("not base_failed").toPandas()
    junk = (rows.n_symbols > 0.2 * rows.n_words) | (rows.text.str.count("!!") > 0.2 * rows.n_words)
    assert rows[~junk].kept.mean() > 0.97
    assert rows[junk].kept.mean() < 0.2


def test_without_labels_and_empty(docs, none, labels):
    rows = rules.verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.score == 0 for r in rows)
    assert rules.verdicts(none, labels).count() == 0


def test_the_main_path_runs_no_python(docs, labels):
    ratios = rules.log_ratios(docs, rules.bounded_sample(labels).where("label = 1"), "doc_id", "text")
    plan = rules.with_scores(docs, ratios, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_the_threshold_is_fitted_on_every_label(docs, labels, monkeypatch):
    """Verdicts do not change with the size of a sample."""
    kept = lambda: sorted((r.doc_id, r.kept) for r in rules.verdicts(docs, labels).collect())
    want, none = kept(), rules.bounded_sample(labels, 0)
    monkeypatch.setattr(rules, "bounded_sample", lambda labels: none)
    assert kept() == want


def test_texts_are_scored_inside_their_rows(docs, labels):
    """No n-gram becomes a row of its own, nothing is shuffled, and no sort calls a lambda per comparison."""
    ratios = rules.log_ratios(docs, rules.distinct_labels(labels).where("label = 1"), "doc_id", "text")
    plan = rules.with_scores(docs, ratios, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Join|Aggregate |array_sort", plan)
