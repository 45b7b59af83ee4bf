"""Every registered query against its SQL in an independent engine."""

import inspect

import compare
import pytest

import __spark_entry__ as entry_points
from stationlens.plans.oracles import ORACLES
from stationlens.plans.registry import QUERIES

ROWS_ONLY = {"krige_variance"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows, problems = compare.differences(df, duck, ORACLES[name])
    assert not problems
    assert rows > 0
    assert_no_all_pairs(df)


def assert_no_all_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs_over_all_snapshots(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert_no_all_pairs(df)


def test_only_unsolvable_ones_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.queries()) >= set(QUERIES)
    assert set(entry_points.oracle_sql()) >= set(ORACLES)


def test_queries_take_session_and_folder():
    for fn in QUERIES.values():
        assert len(inspect.signature(fn).parameters) == 2
