from __future__ import annotations

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from furrow.llm import pii, simhash
from test_decontaminate import brute as leaks
from test_pii import brute as base_spans
from test_simhash import brute as groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir, docs):
    """Each stage's input and output."""
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf_dir).cache()
        out[name] = (now, after)
        now = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_registered():
    assert [n for n in entry.queries() if n.startswith("op")] and entry.queries()["pipeline"] is corpus_pipeline.run
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14))


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_quality(stages, labels):
    before, after = stages["quality"]
    gone = set(ids(before)) - set(ids(after))
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert gone & bad and len(gone) < 0.4 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = groups([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted({c for _, _, c in rows})


def test_leaks_go(stages, spark, sf_dir):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {d for d, _ in leaks([(r.doc_id, r.text) for r in before.collect()], items)}
    assert ids(after) == sorted(set(ids(before)) - found)


def test_personal_data_is_masked(stages):
    before, after = stages["personal_data"]
    assert ids(before) == ids(after)
    text = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        spans = [r.text[s:e] for found in base_spans(r.text).values() for s, e in found]
        if spans:
            assert text[r.doc_id] != r.text and "[" in text[r.doc_id]
        for s in spans:
            assert s not in text[r.doc_id]


def test_pieces(stages):
    before, after = stages["pieces"]
    rows = after.collect()
    assert ids(before) == ids(after) and all(r.lossless and len(r.ids) == r.n_pieces for r in rows) and "text" not in after.columns


def test_run(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages["pieces"][1])


def test_odd_rows(spark, sf_dir, odd, none):
    for df in (odd, none):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
        assert now.count() <= df.count()
    assert simhash and pii
