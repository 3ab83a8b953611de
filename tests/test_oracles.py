"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from oracle import compare

from shotloom import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_every_query_has_sql():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"window_shuffle_buffer"}  # held against Python in test_passes


@pytest.mark.parametrize("name", ["window_cuts", "shot_time_range", "pooled_stats_two_stage", "transform_plan"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["windows_markovian", "windows_in_blocks", "window_metrics_persistence", "window_screen_sparse"])
def test_windows_take_one_arrow_stage(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_what_it_needs(spark):
    plan = queries.shot_signal_stats(spark, SF)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("ReadSchema") :]
    assert "l_shipdate" not in scan and "l_extendedprice" in scan
    plan = queries.source_profile(spark, SF)._jdf.queryExecution().toString()
    assert "ts" not in plan[plan.rindex("ReadSchema") :].split("struct<")[1].split(">")[0]


@pytest.mark.parametrize("name", ["window_metrics_persistence", "window_metrics_mean"])
def test_windows_stay_with_their_shot(spark, name):
    """Shuffles of the executed plan: the daily means, the shots, and the statistics of signals."""
    df = queries.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert sum(line.strip(" :+-*()0123456789").startswith("Exchange") for line in final.splitlines()) <= 4
