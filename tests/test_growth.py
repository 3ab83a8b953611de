"""What a step moves or holds grows with its input, not faster, and no task or group gets it all."""

import pytest
from pyspark.sql import functions as F

from shotloom import queries
from shotloom.operators import batching, metrics, stats
from shotloom.plans import evaluation, views
from shotloom.streaming import rollup

SF = "/root/testdata/sf0.001"


def test_counted_parts_are_far_fewer_than_the_cells(spark):
    sizes = spark.createDataFrame([(n,) for n in (101, 600, 10_000, 10**9)], "n long")
    got = {r.n: r.parts for r in sizes.withColumn("parts", stats.parts_of(F.col("n"), 1024, 100)).collect()}
    assert got == {101: 16, 600: 24, 10_000: 400, 10**9: 1024}
    assert [r.p for r in sizes.select(stats.parts_of(F.col("n"), 4, 100).alias("p")).collect()] == [4] * 4


def test_levels_are_made_once(spark, monkeypatch):
    plans, check = [], metrics.validate
    monkeypatch.setattr(metrics, "validate", lambda rows, *of: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), check(rows, *of)))
    queries.metric_levels_csv(spark, SF).collect()
    assert len(plans) == 5 and not any("Exchange" in p or "MapInArrow" in p for p in plans)


def test_batches_are_dealt_without_values(spark):
    plan = queries.window_batches(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert sum("values" in line for line in made) == 1 < len(made)


def test_the_stream_is_spread_over_buckets(spark):
    mark = queries._rolled_up(spark, SF)
    assert rollup.state(spark, mark, "totals").select("bucket").distinct().count() > 4


def test_shots_are_packed_once_for_both_forecasts(spark):
    every, _ = queries._forecasts(spark, SF)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "Exchange" not in plan


def test_a_run_reads_the_events_once(spark, monkeypatch):
    reads, read = [], views.read
    monkeypatch.setattr(views, "read", lambda spark, d, name: (reads.append(name), read(spark, d, name))[1])
    queries.task_run_report(spark, SF)
    assert reads == ["events"]


@pytest.mark.parametrize("block", [None, 10.0])
def test_first_windows_are_made_alone_and_once(spark, block):
    plan = queries.first_windows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    sig, meta, key = queries._sig(spark, SF).localCheckpoint(), views.event_meta(spark), ["shot_id", "window_index", "role", "signal"]
    every, few = (evaluation.make_windows(sig, meta, queries.FORECAST, filled=False, block=block, first=n) for n in (None, 2))
    got, want = (sorted((str(r) for r in batching.first_windows(w, 2).select(*key, "values").collect())) for w in (few, every))
    assert got == want and len(got) > 20
    numbers = sorted({(r.shot_id, r.window_index) for r in every.select("shot_id", "window_index").distinct().collect()})
    least = {shot: [w for s, w in numbers if s == shot][:2] for shot in {s for s, _ in numbers}}
    assert {(r.shot_id, r.window_index) for r in batching.first_windows(few, 2).select(*key).collect()} == {(s, w) for s, ws in least.items() for w in ws}
    assert few.count() == len(got) if block is None else few.count() < every.count()
