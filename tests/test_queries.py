"""Every registered query against its SQL in a second engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert {n for n in set(QUERIES) - set(SQL) if n != "pipeline" and not n.startswith("op")} == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert differences(df, con, SQL[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["assign_best_scene", "fields_by_scene", "class_index", "split_assign", "multitemporal_stack"])
def test_same_without_broadcast_and_adaptive_plans(spark, sf_dir, con, name):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["split_assign", "split_external", "batch_plan", "class_weights", "combine_report"])
def test_ids_are_read_without_pixels(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "vec_id" in plan or "label" in plan
    assert "embedding:array" not in plan


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_baseline_scores(spark, sf_dir):
    rows = {r["name"]: r["value"] for r in QUERIES["baseline_eval"](spark, sf_dir).collect()}
    assert set(rows) == {"accuracy", "macro_accuracy", "macro_f1", "loss"}
    assert 0.0 <= rows["accuracy"] <= 1.0 and rows["loss"] > 0.0
